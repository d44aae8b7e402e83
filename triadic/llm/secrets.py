"""Secret scan: fixed patterns, and the cost of guessing values that stand in a credential context.

The patterns give the base spans (kinds assign, access, hex). The method adds spans of kind guess: where
a credential word is followed by a separator and a value, the value's guess cost is the cheapest way to
write it as a sequence of segments, found by dynamic programming over its characters:

* a known word (in any case, with common letter swaps): its rank among the common passwords and then the words of
  a public vocabulary, doubled for capitals or swaps;
* a date (4 to 8 digits, with or without separators): 366 days times the distance in years to 2000, 20 at least;
* a repeat of one unit of 1 to 4 characters, however long: the cost of the unit by brute force times the number of repeats;
* a keyboard walk of 3 or more neighbouring keys, however long: 47 keys times its length, times 4 for each change of direction;
* any other span by brute force: 10 guesses a digit, 26 a letter, 33 any other character.

Costs multiply along segments and a sequence of k segments costs k! times more, as in password-strength
estimation. A value whose cost is at least 10 ** min_log10 guesses is reported: easy words that follow
"password:" in prose are not secrets, random strings are.

A null text counts as empty: no spans. Rows are independent, so ties and repeated rows need no rule; rows
keep a null doc_id; an empty table gives an empty result; other columns are not read. Whole texts are
scanned, of any length; a value of n characters costs time in proportion to n times the longest word, as
repeats and walks keep only the starts that can still be the cheapest, and values that pass the limit are left early.
"""

from __future__ import annotations

import base64
import math
import re

from pyspark.sql import DataFrame

from triadic.llm.common import short_batches

KINDS = ("assign", "access", "hex", "guess")

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

# Words that announce a credential, and words that people use as passwords, commonest first.
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|auth(?:orization)?|bearer|(?:access|private|secret|client|account|encryption)[_-]?(?:key|secret))["']?\x20*(?:[:=]|\x20(?:is|was)\x20)\x20*["']?([^\s"'<>]{6,})""",
    re.ASCII,
)
COMMON_WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess football baseball shadow sunshine "
    "iloveyou michael jordan super secret hello charlie love summer winter spring autumn flower hunter freedom computer "
    "internet access test user root guest default system manager private public company office example sample token key "
    "the and for that with this from have not you are was will can all one time year good new first last day home work "
    "house dog cat fish tiger lion eagle horse star moon sun earth fire water silver gold black white red blue green "
    "orange purple king queen angel devil magic power money lucky happy batman superman pokemon google apple server "
    "database backup changeme temp pass word"
).split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SWAPS = {"@": "a", "4": "a", "3": "e", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

MIN_LOG10 = 9.0
#: Least characters of a repeat, by its unit's; log10 of the choices for a turn; the most characters of a date.
FIRST, WALK_TURN, LONGEST_DATE = {1: 3, 2: 4, 3: 6, 4: 8}, math.log10(4), 10
#: Words after the common ones come from this vocabulary, by rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A text that holds none of these in small letters has no context and no assignment.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer")


def _adjacent() -> dict[str, dict[str, tuple[int, int]]]:
    """Keys that touch, with the direction as rows down and places right: neighbours in a row, and the two keys above and below.

    Each row starts half a key (the letters: one key) further right, so the key below place i is i or i - 1.
    """
    place = {key: (r, i + (r > 0)) for r, row in enumerate(KEY_ROWS) for i, key in enumerate(row)}
    at = {where: key for key, where in place.items()}
    steps = ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
    return {key: {at[r + dr, i + di]: (dr, di) for dr, di in steps if (r + dr, i + di) in at} for key, (r, i) in place.items()}


ADJACENT = _adjacent()
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)\d{1,2}\1\d{1,2}|\d{1,2}([-/._]?)\d{1,2}\2(?:19|20)?\d\d|(?:19|20)\d\d)")


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _orders(k: int) -> float:
    """log10 of k!."""
    return math.lgamma(k + 1) / math.log(10)


class _Open:
    """Starts of segments that grow by one rule, for one number of segments before them: cost = base + log10(length) at any later end.

    Of two starts the earlier one, once it is the cheaper, stays so, as the quotient of the lengths falls. So a start that
    is not the cheapest when it comes is left out for good, and so is an earlier one with no smaller base.
    """

    def __init__(self):
        self.starts: list[tuple[int, float]] = []

    def put(self, start: int, base: float, end: int) -> None:
        if base + math.log10(end - start) < self.least(end):
            self.starts = [x for x in self.starts if x[1] < base]
            self.starts.append((start, base))

    def least(self, end: int) -> float:
        return min((base + math.log10(end - start) for start, base in self.starts), default=math.inf)


def guess_cost(value: str, words: dict[str, int] | None = None, limit: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes, or limit if that is not more.

    For each end the least cost is kept for each number of segments, as k segments cost k! more in the end. What
    reaches the limit, or the cost of a segmentation that is found first by keeping one number of segments for each end, is
    dropped at once.
    """
    words = RANKS if words is None else words
    if not value:
        return 0.0
    if math.isinf(limit):
        limit = _least_cost(value, words, limit, True) + 1e-9
    return _least_cost(value, words, limit, False)


def _least_cost(value: str, words: dict[str, int], limit: float, single: bool) -> float:
    longest, n = max(map(len, words), default=0), len(value)
    low = value.lower()
    if len(low) != n:  # a letter whose small form is longer
        low = value
    plain = "".join(SWAPS.get(c, c) for c in low)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _char_cost(c))
    bound = min(limit, brute[n])
    best: list[dict[int, float]] = [{0: 0.0}]  # by end: least cost for each number of segments
    going: dict[int, float] = {}  # the same where the last segment is by brute force and goes on
    dates: dict[int, list[tuple[int, float]]] = {}
    walk, changes, repeats, same = {}, [0] * n, {u: {} for u in FIRST}, dict.fromkeys(FIRST, 0)
    alive = 0

    def offer(into: dict[int, float], k: int, cost: float) -> None:
        if cost + _orders(k) < bound and cost < into.get(k, math.inf):
            into[k] = cost

    step_of = lambda m: ADJACENT.get(low[m], {}).get(low[m + 1])
    for j in range(1, n + 1):
        now: dict[int, float] = {}
        c = brute[j] - brute[j - 1]
        went_on, going = going, {}
        for k, cost in went_on.items():
            offer(going, k, cost + c)
        for k, cost in best[j - 1].items():
            offer(going, k + 1, cost + c)
        for k, cost in going.items():
            offer(now, k, cost)
        if best[j - 1] and (m := DATE.match(value, j - 1)) and m.end() - m.start() >= 4:
            digits = re.findall(r"(?:19|20)\d\d", m[0])
            years = max(20, abs(int(digits[0]) - 2000)) if digits else 100
            dates.setdefault(m.end(), []).append((j - 1, math.log10(366 * years) if m.end() - m.start() > 4 else math.log10(years)))
        for i, cost in dates.pop(j, ()):
            for k, x in best[i].items():
                offer(now, k + 1, x + cost)
        for i in range(max(0, j - longest), j - 2):
            if not best[i]:
                continue
            rank = words.get(low[i:j])
            swapped = rank is None
            if swapped:
                rank = words.get(plain[i:j])
            if rank is not None:
                changed = swapped + (value[i:j] != low[i:j])
                for k, x in best[i].items():
                    offer(now, k + 1, x + math.log10(rank * 2**changed + 1))
        # Steps lead from key to key; a walk costs its length and a choice of 4 for its first step and each change of direction.
        step = step_of(j - 2) if j > 1 else None
        if j > 2:
            before = step_of(j - 3)
            changes[j - 2] = changes[j - 3] + (step is not None and before is not None and step != before)
            if step is None:
                walk = {}
            elif before is not None:
                for k, x in best[j - 3].items():
                    walk.setdefault(k, _Open()).put(j - 3, x - changes[j - 3] * WALK_TURN, j)
                for k, own in walk.items():
                    offer(now, k + 1, own.least(j) + math.log10(47) + (1 + changes[j - 2]) * WALK_TURN)
        for u, first in FIRST.items():
            if j <= u or value[j - 1] != value[j - 1 - u]:
                same[u] = 0
                repeats[u].clear()
                continue
            same[u] += 1
            i = j - first
            if i >= 0 and same[u] >= first - u:
                for k, x in best[i].items():
                    repeats[u].setdefault((j % u, k), _Open()).put(i, x + brute[i + u] - brute[i] - math.log10(u), j)
            for (phase, k), own in repeats[u].items():
                if phase == j % u:
                    offer(now, k + 1, own.least(j))
        now, going = _undominated(now), _undominated(going)
        if single and now:
            k = min(now, key=lambda k: now[k] + _orders(k))
            now, going = {k: now[k]}, {k: x for k, x in going.items() if k == min(going, key=lambda k: going[k] + _orders(k))}
        best.append(now)
        if now or going:
            alive = j
        elif not walk and not any(repeats.values()) and j - alive > max(longest, LONGEST_DATE):
            return bound
    return min([bound, *(cost + _orders(k) for k, cost in best[n].items())])


def _undominated(states: dict[int, float]) -> dict[int, float]:
    """Without numbers of segments that cost no less than a smaller number: whatever follows, the smaller one stays as good."""
    out, least = {}, math.inf
    for k in sorted(states):
        if states[k] < least:
            out[k] = least = states[k]
    return out


def ranks(words) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in words:
        out.setdefault(w, len(out) + 1)
    return out


RANKS = ranks(COMMON_WORDS)


def vocabulary_words(path: str) -> list[str]:
    """The words of a byte-level vocabulary of ranks, commonest first, in small letters: its tokens of a space and three letters or more."""
    found = []
    with open(path, "rb") as f:
        for token, _ in sorted((line.split() for line in f if line.strip()), key=lambda x: int(x[1])):
            word = base64.b64decode(token).decode("utf-8", "replace")
            if word[0] == " " and len(word) > 3 and word[1:].isalpha():
                found.append(word[1:].lower())
    return found


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """(start, kind number, end as string...) of the fixed patterns, unsorted."""
    low = text.lower() if low is None else low
    found = []
    if any(h in low for h in ("pass", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def guessed_spans(text: str, low: str | None = None, min_log10: float = MIN_LOG10, words=None) -> list[tuple[int, int, str]]:
    """Spans of values in a credential context that would take at least 10 ** min_log10 guesses."""
    low = text.lower() if low is None else low
    if not any(h in low for h in HINTS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:)")
        if len(value) >= LEAST_ASSIGN and guess_cost(value, words, min_log10) >= min_log10:
            found.append((m.start(1), 3, m.start(1) + len(value)))
    return found


def find_secrets(docs: DataFrame, min_log10: float = MIN_LOG10, words=COMMON_WORDS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; end exclusive, in code points) for each row of docs. Known words are `words`, then those of the vocabulary file, which the driver reads."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks([*words, *(vocabulary_words(vocabulary) if vocabulary else ())]))  # a vocabulary's words
    short_batches(docs.sparkSession)
    span = "array<struct<kind: string, start: int, end: int>>"

    def scan(batches):
        import pyarrow as pa

        table = shipped.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        shaped = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]
        for batch in batches:
            base, every = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                low = text.lower()
                own = base_spans(text, low)
                base.append(shaped(own))
                every.append(shaped(own + guessed_spans(text, low, min_log10, table)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}")


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_guess"),
    )


def base_secret_spans(spark, sf_dir: str) -> DataFrame:
    """What op7 finds by the fixed patterns alone, which SQL can express."""
    return op7_secret_scans(spark, sf_dir).drop("spans", "n_guess")


_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_PATTERNS = ((0, rf"""(?:{_ANY_CASE})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""), (1, "AKIA[A-Z0-9]+"), (2, "[0-9a-f]+"))
#: Matches and what lies between them, put one after the other, give the places.
BASE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS kind, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS between FROM t" for k, p in _PATTERNS)}),
y AS (SELECT doc_id, kind, found, between, unnest(range(1, len(found) + 1)) AS i FROM x),
z AS (SELECT doc_id, kind, found[i] AS s, list_sum(list_transform(between[1:i], lambda b: length(b))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda b: length(b))), 0) AS a FROM y),
b AS (SELECT doc_id, kind, a::BIGINT AS a, (a + length(s))::BIGINT AS z FROM z
    WHERE length(CASE WHEN kind = 0 THEN regexp_extract(s, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE s END) >= CASE kind WHEN 0 THEN {LEAST_ASSIGN} WHEN 1 THEN {LEAST_ACCESS} ELSE 24 END)
SELECT t.doc_id, count(b.a) FILTER (kind = 0) AS n_assign, count(b.a) FILTER (kind = 1) AS n_access, count(b.a) FILTER (kind = 2) AS n_hex,
    sha256(coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind), '')) AS base_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id GROUP BY t.doc_id
"""
