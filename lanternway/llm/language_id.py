"""Language identification in two levels: family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the whole text (ASCII lower-cased, with end marks), as unit
vectors. Families are separated by one-versus-one linear support vector machines too; inside the chosen
family every pair of languages has its own machine and the votes decide. All machines are trained
by dual coordinate descent, on about `SAMPLE` labelled documents (a documented bound of the
training sample, split evenly over the languages); prediction covers every row and whole texts. Of more
than half as many languages as the sample has rows, the most frequent are learned (2000 by default).
The sample is written to the shared folder and machines are trained in tasks, up to `TRAINERS` at once;
the driver gets their weights, never a document's profile.

Defined results: null text, or text without a letter, gives ``und`` with score 0; so does every text
if nothing could be learned (no labelled rows). Ties of votes go to the larger sum of margins, then to
the smaller name. Rows with a null id are predicted, never learned from, and count as not held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.llm.common import pick, slices, strings, written

#: Rows of the training sample at most, over all languages, and the width of the hashed features.
SAMPLE, WIDTH = 4000, 4096
#: Groups that the machines are dealt to, at most; each gets the rows of its languages once.
TRAINERS = 16
#: Texts whose profiles (16 KB each) are held at a time.
AT_ONCE = 1024
UNDETERMINED = "und"
#: Language families, fixed values; a language not listed here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}


def family_of(lang: str) -> str:
    return next((f for f, of in FAMILIES.items() if lang in of), lang)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def profiles(texts: list[str]) -> np.ndarray:
    """A row of hashed trigram counts, scaled to length 1, for each text."""
    raw = [b"\0" + t.encode("utf-8", "surrogatepass").lower() + b"\0" for t in texts]
    out = np.zeros((len(raw), WIDTH), np.float32)
    for i, b in enumerate(raw):
        a = np.frombuffer(b, np.uint8).astype(np.uint32)
        if len(a) < 3:
            continue
        gram = a[:-2] | a[1:-1] << 8 | a[2:] << 16
        out[i] = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=WIDTH)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-9)[:, None]


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a soft-margin SVM with hinge loss, by dual coordinate descent."""
    return descended(np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1), y, cost, epochs)


def descended(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12) -> np.ndarray:
    """`linear_svm` on rows that end with the 1 of the bias."""
    square = np.einsum("ij,ij->i", x, x)
    w, alpha, rng = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Machines:
    """One-versus-one machines over `names`: column k of `weights` separates `pairs[k]`."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: list[str]) -> Machines:
        names, own = tuple(sorted(set(labels))), np.array(labels)
        pairs = tuple(combinations(range(len(names)), 2))
        columns = []
        for a, b in pairs:
            rows = np.flatnonzero((own == names[a]) | (own == names[b]))
            columns.append(linear_svm(x[rows], np.where(own[rows] == names[a], 1.0, -1.0)))
        return Machines(names, pairs, np.stack(columns, 1) if columns else np.zeros((x.shape[1] + 1, 0), np.float32))

    @staticmethod
    def of(names: list[str], weights: Callable[[str, str], np.ndarray]) -> Machines:
        """The machines over `names` from the weights of each pair."""
        names = tuple(sorted(names))
        columns = [weights(a, b) for a, b in combinations(names, 2)]
        return Machines(names, tuple(combinations(range(len(names)), 2)), np.stack(columns, 1) if columns else np.zeros((WIDTH + 1, 0), np.float32))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, score between 0 and 1) of each row."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes, sums = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k].astype(float)
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            sums[:, a] += m
            sums[:, b] -= m
        best = (votes + 0.4 * np.tanh(sums / max(1, len(self.names)))).argmax(1) if len(self.names) else np.zeros(len(x), int)
        score = 1 / (1 + np.exp(-2 * sums[np.arange(len(x)), best] / max(1, len(self.names) - 1))) if self.pairs else np.ones(len(x))
        return best, score


@dataclass(frozen=True)
class Model:
    families: Machines
    within: dict[str, Machines]

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> Model | None:
        if not langs:
            return None
        own = np.array([family_of(z) for z in langs])
        return Model(Machines.fit(x, own.tolist()), {f: Machines.fit(x[own == f], [z for z, g in zip(langs, own, strict=True) if g == f]) for f in sorted(set(own))})

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; profiles of `AT_ONCE` texts are held at a time."""
        parts = [self._predict(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
        return [z for langs, _ in parts for z in langs], np.concatenate([np.zeros(0), *(score for _, score in parts)])

    def _predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x = profiles(texts)
        family, score = self.families.choose(x)
        out = np.empty(len(texts), object)
        for k, f in enumerate(self.families.names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                lang, inner = self.within[f].choose(x[rows])
                out[rows] = np.array(self.within[f].names, object)[lang]
                score[rows] *= inner
        for i, t in enumerate(texts):
            if not has_letter(t):
                out[i], score[i] = UNDETERMINED, 0.0
        return out.tolist(), score


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32, as text, is divisible by 5: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Train on about `sample` labelled rows that are not held out, evenly over the languages."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample // 2).collect()}
    if not count:
        return None
    # a fixed pseudo-random share of each language, from a hash of the id
    share = F.create_map(*[F.lit(v) for z, n in count.items() for v in (z, min(1.0, sample / len(count) / n))])
    draw = (F.xxhash64("doc_id", F.lit("sample")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    chosen = rows.where(draw < F.element_at(share, F.col("lang")))

    def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            places, values = zip(*map(packed, profiles(strings(batch.column(1)))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "lang", "places", "x"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return trained(written(chosen.mapInArrow(count_grams, f"doc_id {id_type}, lang string, places binary, x binary").limit(2 * sample), "language-sample"))


def packed(row: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of a profile's numbers that are not zero."""
    places = np.flatnonzero(row)
    return places.astype("<u2").tobytes(), row[places].tobytes()


def trained(sample: DataFrame) -> Model | None:
    """The model of a written sample, ``doc_id, lang, places, x``: each trainer fits its share of the machines."""
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    of: dict[str, list[str]] = {}
    for z in langs:
        of.setdefault(family_of(z), []).append(z)
    # a machine: None and two families, or a family and two of its languages
    machines = [(None, a, b) for a, b in combinations(sorted(of), 2)] + [(f, a, b) for f in sorted(of) for a, b in combinations(of[f], 2)]
    trainers: dict[str, set[int]] = {z: set() for z in langs}
    for k, (f, *sides) in enumerate(machines):
        for z in sides if f is not None else [z for side in sides for z in of[side]]:
            trainers[z].add(k % TRAINERS)

    def train(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, own = rows.column("doc_id").to_pylist(), rows.column("lang").to_pylist()
        places, x = rows.column("places").to_pylist(), rows.column("x").to_pylist()
        order = sorted(range(len(own)), key=lambda i: (str(ids[i]), own[i], places[i], x[i]))
        mine, weights = range(key[0].as_py(), len(machines), TRAINERS), []
        family = [family_of(z) for z in own]
        for f, a, b in (machines[k] for k in mine):
            name = family if f is None else own
            use = [i for i in order if name[i] in (a, b)]
            dense = np.zeros((len(use), WIDTH + 1), np.float32)
            dense[:, WIDTH] = 1
            for row, i in zip(dense, use, strict=True):
                row[np.frombuffer(places[i], "<u2")] = np.frombuffer(x[i], np.float32)
            weights.append(descended(dense, np.where([name[i] == a for i in use], 1.0, -1.0)).tobytes())
        return pa.table({"machine": pa.array(mine, pa.int32()), "weights": pa.array(weights, pa.binary())})

    weights: dict[tuple[str | None, str, str], np.ndarray] = {}
    if machines:
        spark = sample.sparkSession
        dealt = spark.createDataFrame([(z, t) for z, to in trainers.items() for t in sorted(to)], "lang string, trainer int")
        fitted = sample.join(F.broadcast(dealt), "lang").groupBy("trainer").applyInArrow(train, "machine int, weights binary")
        weights = {machines[r["machine"]]: np.frombuffer(r["weights"], np.float32) for r in fitted.collect()}
    return Model(Machines.of(list(of), lambda a, b: weights[None, a, b]), {f: Machines.of(of[f], lambda a, b, f=f: weights[f, a, b]) for f in sorted(of)})


def labelled(docs: DataFrame, model: Model | None, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of the input plus language and score, named `into`; these must be new names (`free_name` finds some)."""
    if {c.lower() for c in into} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {into} are there already")
    at = docs.columns.index(text_col)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2 << 20):
            texts = strings(batch.column(at))
            langs, score = model.predict(texts) if model else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predict, f"{fields}, `{into[0]}` string, `{into[1]}` double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    found = labelled(pick(docs, doc_id=id_col, text=text_col), learn(docs, id_col, text_col, lang_col))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
