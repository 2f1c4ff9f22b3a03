"""Secret scan by assignment-aware lexing (operator 12).

Three patterns find what looks like a secret wherever it stands (``assign``, ``access``, ``hex``). Beside them every
text is read as source code or configuration: a lexer cuts its lines into strings, words and operators,
and a small parser makes name-literal pairs of them:

* ``name = literal``, also ``:=``, ``=>``, ``+=`` and ``:``, with plain, dotted, quoted and subscripted names
  and type annotations; adjacent and added strings, values in brackets over several lines, defaults of calls;
* ``setName(literal)``, ``call("name", literal)``, ``<name>literal</name>``, ``name="..." value="..."``, ``--name literal``.

Constants are propagated: a name on the right stands for its last definition before that place, else the
first one after it, so a literal counts for every name that it reaches. A literal is reported (kind
``lexed``, the span of its characters without quotes) if a name that it reaches is sensitive and the literal is
strong enough for that name (``verdict``). Literals inside a span of a pattern are not reported again.

Lexing, parsing and propagation take time in proportion to the text: a value ends at the next assignment, and
sensitivity spreads over definitions that are visited once. A text is scanned whole, in one task, whatever its
length; texts need no shuffle.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; a null doc_id is
carried along; an empty table gives no rows; other columns, whatever their names, are ignored; spans with one
start are ordered by kind as listed in ``KINDS``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tokenlake.llm.common import small_batches

KINDS = ("assign", "access", "hex", "lexed")


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


_ASSIGN = re.compile(f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: every match of _ASSIGN holds one of these, letters in either case
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
# a run that is long enough is found whole, and a run that is too short has no longer one inside
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the three patterns match, leftmost and non-overlapping in each kind."""
    spans = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(hint in folded for hint in _ASSIGN_HINTS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    return sorted(spans, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


# ---------------------------------------------------------------- lexer

_HINT = re.compile(r'[=:()+"]')
_TOKEN = re.compile(
    r"""(?P<string>(?:(?<![\w\\])|(?<=\b[rbfuRBFU]))(?:"((?:[^"\\]|\\.)*+)"|'((?:[^'\\]|\\.)*+)'|`([^`]*+)`))
      | (?P<op>:// | := | => | === | == | != | <= | >= | \+= | -> | :: | \|\| | [=:+,;(){}\[\]<>])
      | (?P<word>[^\W\d][\w$@.\-]*+ | [$@][\w$@.\-]*+)
      | (?P<rest>[^\s=:+,;(){}\[\]<>"'`]++ | \S)""",
    re.VERBOSE,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_NAME = re.compile(r"[^\W\d][\w$@.\-]*")
_ASSIGNS = frozenset(("=", ":=", "=>", ":", "+="))
_JOINS = frozenset(("+", "||", "or", "else"))
_LOOKUPS = frozenset(("get", "getenv", "environ", "env", "getproperty", "lookup", "input", "prompt", "getpass"))
_SETTERS = re.compile(r"(?:.*\.)?(?:set|with)(?:_|(?=[A-Z]))")

Token = tuple[str, str, int, int]  # kind, text, start, end; of a string what stands between its quotes


def lex(text: str) -> list[Token]:
    """The tokens of the lines that can hold an assignment or a call, a ``line`` token after each line."""
    tokens: list[Token] = []
    at = 0
    while hint := _HINT.search(text, at):
        start = max(text.rfind("\n", at, hint.start()) + 1, at)
        end = text.find("\n", hint.end())
        end = len(text) if end < 0 else end
        for m in _TOKEN.finditer(text, start, end):
            kind = m.lastgroup
            if kind == "string":
                group = next(g for g in (2, 3, 4) if m[g] is not None)
                tokens.append((kind, m[group], *m.span(group)))
            else:
                tokens.append((kind, m[0], *m.span()))
        tokens.append(("line", "\n", end, end))
        at = end + 1
    return tokens


# ---------------------------------------------------------------- parser


class Pair:
    """A name, the literals written for it, (start, end, quoted), and the names that its value refers to."""

    __slots__ = ("literals", "name", "refs")

    def __init__(self, name: str):
        self.name, self.literals, self.refs = name, [], []


def _target(tokens: list[Token], i: int) -> str | None:
    """The name that the operator at ``i`` assigns to."""
    if i == 0:
        return None
    kind, text, _, _ = tokens[i - 1]
    before = [t[1] for t in tokens[max(0, i - 3) : i]]
    if kind == "word":
        if len(before) > 1 and before[-2] == "://":
            return None  # a host and its port
        if tokens[i][1] == "=" and len(before) == 3 and before[1] == ":" and tokens[i - 3][0] in ("word", "string"):
            return tokens[i - 3][1]  # name: type = value
        return text
    if kind == "string":
        return text
    if kind == "rest" and text.startswith("--"):
        return text.lstrip("-")
    if text == "]" and len(before) == 3 and before[0] == "[" and tokens[i - 2][0] == "string":
        return before[1]
    return None


def _value(text: str, tokens: list[Token], i: int, pair: Pair) -> None:
    """Reads the value from token ``i`` on, up to its end or the next assignment."""
    depth, skip, wanted, n = 0, 0, True, len(tokens)
    while i < n:
        kind, s, a, b = tokens[i]
        follows = tokens[i + 1][1] if i + 1 < n and tokens[i + 1][0] in ("op", "word") else ""
        if kind == "line":
            if not (depth or wanted and (pair.literals or pair.refs) or follows == "+"):
                return
        elif kind == "string":
            if follows in _ASSIGNS or not (wanted or depth or pair.literals):
                return  # the next key
            if skip == 0:
                pair.literals.append((a, b, True))
            wanted = False
        elif s in _JOINS:
            wanted = True
        elif s == "(":
            depth += 1
        elif s == ")":
            if depth == 0:
                return
            depth, skip = depth - 1, 0
        elif s == ",":
            if depth == 0:
                return
            skip = max(0, skip - 1)
        elif kind in ("word", "rest"):
            padded = follows == "=" and tokens[i + 1][2] == b and text[b + 1 : b + 2] in ("", " ", "\t", "\n", ",", ";")
            if follows in _ASSIGNS and not (padded and wanted):
                if depth == 0:
                    pair.refs.append(s)
                return
            if follows == "(":
                skip = int(s.rpartition(".")[2].lower() in _LOOKUPS)
            elif kind == "word" and len(s) <= 2 and i + 1 < n and tokens[i + 1][0] == "string" and tokens[i + 1][2] == b + 1:
                pass  # a prefix such as b"..."
            elif not wanted:
                return
            else:
                bare = _BARE.match(text, a)
                if kind == "word" and (depth or text[bare.end() : bare.end() + 1] in ('"', "'", "`", "[") or bare.end() == b and follows == "+"):
                    pair.refs.append(s)
                else:
                    pair.literals.append((a, bare.end(), False))
                    while i + 1 < n and tokens[i + 1][2] < bare.end():
                        i += 1
                wanted = False
        else:
            return
        i += 1


_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>\s*([^<>\s]++)\s*</")
_FLAG = re.compile(r"""(?<![\w\-])--([A-Za-z][\w\-]*+)\x20+(["']?)([^\s"']++)""")


def parse(text: str) -> list[Pair]:
    """The name-literal pairs of a text in their order."""
    tokens, pairs, labelled = lex(text), [], None
    for i, (kind, s, _, _) in enumerate(tokens):
        if kind == "line":
            labelled = None
        elif kind == "op" and s in _ASSIGNS and (name := _target(tokens, i)):
            pair = Pair(name)
            _value(text, tokens, i + 1, pair)
            written = text[slice(*pair.literals[0][:2])] if pair.literals else ""
            if name.lower() in ("name", "key") and written:
                labelled = written
            elif name.lower() in ("value", "default", "content") and labelled:
                pair.name, labelled = labelled, None
            pairs.append(pair)
        elif kind == "op" and s == "(" and i and tokens[i - 1][0] == "word" and i + 1 < len(tokens) and tokens[i + 1][0] == "string":
            after = [t[1] if t[0] == "op" else t[0] for t in tokens[i + 2 : i + 5]]
            if after[:1] == [")"] and (m := _SETTERS.match(tokens[i - 1][1])):
                pairs.append(Pair(tokens[i - 1][1][m.end() :]))
                pairs[-1].literals.append((*tokens[i + 1][2:], True))
            elif after == [",", "string", ")"]:
                pairs.append(Pair(tokens[i + 1][1]))
                pairs[-1].literals.append((*tokens[i + 3][2:], True))
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            pairs.append(Pair(m[1]))
            pairs[-1].literals.append((*m.span(2), True))
    if "--" in text:
        for m in _FLAG.finditer(text):
            pairs.append(Pair(m[1]))
            pairs[-1].literals.append((*m.span(3), bool(m[2])))
    return pairs


# ---------------------------------------------------------------- scores

# What names and literals are made of.
SECRET_WORDS = frozenset("password passwd passwort pwd passphrase passcode secret token credential credentials apikey secretkey privatekey".split())
KEY_KINDS = frozenset("api access private auth secret encryption signing master client account session".split())
WEAK_WORDS = frozenset("key auth cred creds pass salt signature bearer".split())
HARMLESS_ENDS = frozenset(
    "file path name url uri host port length len size count min max type policy field label hint prompt header regex pattern format "
    "expires expiry ttl timeout error message text title class input index limit id enabled required version".split()
)
PLACEHOLDERS = re.compile(r"change_?me|example|placeholder|your[_-]|dummy|sample|redacted|xxxx|\*{3}|\.{3}|todo|undefined", re.IGNORECASE)
TEMPLATE = re.compile(r"\$\{|\{\{|%\(|%s|\$\(|^\$\w+$|^<.*>$|^\w+://")
STRONG_BITS, WEAK_BITS, LEAST_CHARS = 20.0, 48.0, 8

_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_a-zA-Z]+")


def sensitivity(name: str) -> int:
    """2 for the name of a secret, 1 for a name that may be one, 0 for any other."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in HARMLESS_ENDS:
        return 0
    if SECRET_WORDS.intersection(words) or "tokens" in words or "passwords" in words:
        return 2
    if any(a in KEY_KINDS and b in ("key", "keys") for a, b in zip(words, words[1:], strict=False)):
        return 2
    return int(words[-1] in WEAK_WORDS)


def bits(literal: str) -> float:
    """Shannon entropy of the characters times their number."""
    n = len(literal)
    return sum(-c * math.log2(c / n) for c in Counter(literal).values())


def verdict(literal: str, level: int, quoted: bool) -> bool:
    """Whether the literal is strong enough to be the secret of a name of that sensitivity.

    Values without quotes, which may be prose, and weak names ask for a digit and a letter; weak names also for more bits.
    """
    if level == 0 or len(literal) < LEAST_CHARS or re.search(r"\s", literal) or PLACEHOLDERS.search(literal) or TEMPLATE.search(literal):
        return False
    mixed = any(c.isdigit() for c in literal) and any(c.isalpha() for c in literal)
    return bits(literal) >= (STRONG_BITS if level == 2 else WEAK_BITS) and (mixed or quoted and level == 2)


def _definitions(pairs: list[Pair]) -> dict[str, list[int]]:
    places = defaultdict(list)
    for i, pair in enumerate(pairs):
        for name in {pair.name, pair.name.rpartition(".")[2]}:
            places[name].append(i)
    return places


def _definition(places: dict[str, list[int]], name: str, at: int) -> int | None:
    """The last definition of a name before pair ``at``, else the first one after it."""
    for known in (name, name.rpartition(".")[2]):
        if spots := places.get(known):
            i = bisect_left(spots, at)
            if i:
                return spots[i - 1]
            later = spots[i + 1 :] if spots[i] == at else spots[i:]
            return later[0] if later else None
    return None


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name and are strong enough for it."""
    pairs = parse(text)
    places = _definitions(pairs)
    for i, pair in enumerate(pairs):  # a bare word that is defined is no literal
        for a, b, quoted in list(pair.literals):
            if not quoted and _NAME.fullmatch(text, a, b) and _definition(places, text[a:b], i) is not None:
                pair.literals.remove((a, b, quoted))
                pair.refs.append(text[a:b])
    spans = set()
    for level in (2, 1):  # strong names first: what they reach is judged by their rule
        seen, todo = set(), [i for i, pair in enumerate(pairs) if sensitivity(pair.name) == level]
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            pair = pairs[i]
            if pair.literals and verdict("".join(text[a:b] for a, b, _ in pair.literals), level, all(q for _, _, q in pair.literals)):
                spans.update((a, b, "lexed") for a, b, _ in pair.literals if b > a)
            todo += [j for name in pair.refs if (j := _definition(places, name, i)) is not None]
    return sorted(spans, key=_place)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(spans of the patterns, all spans): sorted by start, then kind."""
    base = base_spans(text or "")
    ends, reach = [], 0  # of the spans up to each one, how far they go
    for _, end, _ in base:
        reach = max(reach, end)
        ends.append(reach)
    starts = [s for s, _, _ in base]
    more = []
    for span in lexed_spans(text or ""):
        i = bisect_left(starts, span[0] + 1)
        if not (i and ends[i - 1] >= span[1]):
            more.append(span)
    return base, sorted(base + more, key=_place)


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 256):
        rows = [scan_text(t.as_py()) for t in batch["text"]]
        kinds = [Counter(kind for _, _, kind in spans) for _, spans in rows]
        counts = [pa.array([c[kind] for c in kinds], pa.int64()) for kind in KINDS]
        digests = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *counts, pa.array(digests, pa.string()), pa.array([shown(spans) for _, spans in rows], pa.string())],
            ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_lexed, base_sha256, spans) of every row; ``spans`` as kind:start:end,
    comma-joined, in code points, ends exclusive; ``base_sha256`` of the patterns' spans alone."""
    kind = dict(docs.dtypes)["doc_id"]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(_scanned, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
