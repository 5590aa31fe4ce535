"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

A candidate is a long token shortly after a word of a sensitive context (``auth``, ``private`` ...).
Each is compressed, whatever its letters and digits, by a compressor primed with a dictionary of
identifiers, once behind its surrounding code and once without it; the marginal bytes tell how new the
string is. Strings that neither the dictionary nor the surroundings explain are reported as ``novel``.

The dictionary is made of the corpus's own words: identifiers of letters and underscores are counted over
all rows and whole texts, and the `FREQUENT` most frequent (at most 32 KB: a bound) go into it, the most
frequent last, behind them a fixed line of common names. It cannot hold a key, however often one has leaked:
a stretch of characters that is long enough to be a candidate gives no word, nor any part of one, wherever it
stands. For the same reason a candidate's other occurrences are taken out of its surroundings.

Defined results: null text counts as empty; no match gives an empty list; spans are in code points,
end exclusive; equal rows give equal results; ties of the count go to the smaller word; other columns of
the input are not read. Time is linear in the text.
Distribution: one scan counts words, combined per batch before its shuffle; one scan, without a shuffle
or state between rows, finds the spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.llm.common import pick, slices, strings

# The kinds and their patterns.
KINDS = ("assign", "access", "hex", "novel")
KEYWORD = "(password|passwd|secret|token|api_?key)"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24


def _either_case(pattern: str) -> str:
    """ASCII letters in either case, without the Unicode folding of re.IGNORECASE."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


ASSIGN = re.compile(_either_case(KEYWORD) + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A greedy run that is too short fails as a whole, so asking for the length at once finds the same runs.
ACCESS = re.compile(f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}")
HEX = re.compile(f"[0-9a-f]{{{MIN_HEX},}}")
HINTS = ("passw", "secret", "token", "api")

# Words of a sensitive context, and what the dictionary is primed with: fixed values.
SENSITIVE = ("secret", "token", "passw", "credential", "auth", "apikey", "api_key", "api-key", "private", "signature", "bearer", "access_key")
IDENTIFIERS = (
    "def class return import from self true false null None static const public private void string int float "
    "username user_name password passwd secret_key access_key api_key apikey token auth_token authorization bearer "
    "credentials client_id client_secret connection_string database_url localhost example.com http:// https://www. "
    "config settings environment production development staging version timestamp created_at updated_at "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme placeholder your_api_key_here xxxxxxxx "
)
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
REACH, AROUND, NOVEL_SHARE = 96, 256, 0.8
#: Identifiers that the dictionary takes from the corpus, of 5 letters and underscores or more, out of stretches
#: of a candidate's characters that are too short for a candidate.
FREQUENT = 2048
STRETCH = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{5,{LEAST - 1}}}(?![A-Za-z0-9+/_=.-])")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{5,}(?![A-Za-z0-9_])")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)))


class Novelty:
    """Marginal compressed bytes of a string behind a context, under a dictionary of identifiers."""

    def __init__(self, own: Sequence[str] = (), level: int = 3) -> None:
        primer = zstandard.ZstdCompressionDict(" ".join([*reversed(own), IDENTIFIERS]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=level)
        self._pack = zstandard.ZstdCompressor(level=level, dict_data=primer, write_content_size=False, write_checksum=False)

    def marginal(self, context: str, candidate: str) -> int:
        behind, raw = context.encode("utf-8", "surrogatepass"), candidate.encode()
        return len(self._pack.compress(behind + b"\n" + raw)) - len(self._pack.compress(behind + b"\n"))


def identifiers(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """The most frequent identifiers of all texts, the most frequent first; ties to the smaller one."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            stretches, found = Counter(), Counter()
            for t in strings(batch.column(0)):
                stretches.update(STRETCH.findall(t))
            for stretch, n in stretches.items():
                for word in IDENTIFIER.findall(stretch):
                    found[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def leading(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        for batch in batches:
            held += [(-n, w) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if len(held) > 8 * most:
                held = sorted(held)[:most]
        held = sorted(held)[:most]
        yield pa.RecordBatch.from_arrays([pa.array([w for _, w in held], pa.string()), pa.array([-n for n, _ in held], pa.int64())], ["word", "n"])

    counted = pick(docs, text=text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # the best of each task, then of 16: what reaches the driver does not grow with the number of tasks
    best = counted.mapInArrow(leading, "word string, n long").repartition(16).mapInArrow(leading, "word string, n long")
    return [r["word"] for r in best.orderBy(F.desc("n"), "word").limit(most).collect()]


def base_spans(text: str, lowered: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start, then kind."""
    lowered = text.lower() if lowered is None else lowered
    found = []
    if any(h in lowered for h in HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def novel_spans(text: str, lowered: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings of a sensitive context that no fixed pattern covers.

    A candidate begins at most `REACH` characters behind a sensitive word; what a word cuts off a longer
    token is a candidate too. No character is measured twice.
    """
    if len(lowered) != len(text):  # a letter whose lower case is longer: offsets would shift
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    found: list[tuple[int, int, int]] = []
    reach = [0]  # the furthest end of the base spans up to each
    for _, y, _ in taken:
        reach.append(max(reach[-1], y))
    done = i = 0
    for hint in _SENSITIVE.finditer(lowered):
        start, stop = max(done, hint.end()), hint.end() + REACH
        while i < len(runs) and runs[i][1] <= start:
            i += 1
        while i < len(runs) and max(runs[i][0], start) <= stop:
            a, b = max(runs[i][0], start), runs[i][1]
            i += 1
            if b - a < LEAST:
                continue
            done = b
            if reach[bisect_left(taken, (b,))] > a:
                continue
            token = text[a:b]
            around = (text[max(0, a - AROUND) : a] + text[b : b + AROUND]).replace(token, " ")
            if novelty.marginal(around, token) >= NOVEL_SHARE * len(token):
                found.append((a, b, 3))
    return found


def scan_text(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    lowered = text.lower()
    base = base_spans(text, lowered)
    more = novel_spans(text, lowered, base, novelty) if any(h in lowered for h in SENSITIVE) else []
    return base, sorted(base + more, key=lambda s: (s[0], s[2])) if more else base


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPAN_DDL = "array<struct<kind:string,start:int,end:int>>"


def as_rows(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> list[dict]:
    return [{"kind": kinds[k], "start": a, "end": b} for a, b, k in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, base, spans`` (arrays of kind, start, end)."""
    rows, own = pick(docs, doc_id=id_col, text=text_col), identifiers(docs, text_col)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(own)
        for batch in slices(batches, "text"):
            both = [scan_text(t, novelty) for t in strings(batch.column(1))]
            lists = [pa.array([as_rows(x[i], KINDS) for x in both], pa.list_(SPAN)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "base", "spans"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {SPAN_DDL}, spans {SPAN_DDL}")
