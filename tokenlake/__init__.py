"""tokenlake: token-transfer analytics on Spark.

Raw event logs and block headers in; decoded, deduplicated transfers, exact
uint256 amounts, listings, aggregates, a JSON feed and call-log roll-ups out.
See README.md for the module map.
"""
