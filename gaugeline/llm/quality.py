"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

One pass over whole texts gives counts and a transformed statistic vector per document. Documents are put in
cells: language and source, or, for a pair with under ``min_cell`` rows, the language, or all, whichever first has so
many. A pooled cell is fitted on *all* rows of its language, or of the table, not on its small sources alone.

Each cell's estimate is the covariance of the share ``h`` of its rows with the least determinant that several starts
lead to: the classical estimate, medians with spreads, spatial signs, and hyperbolic tangents of standardised values.
A concentration step takes the ``h`` rows of least distance and their mean and covariance; it never raises the
determinant. All starts take two steps; the best of each cell goes on until no cell's determinant falls by a hundredth.
The estimate is then reweighted: mean and covariance of all rows within the 0.975 quantile. Steps are over *all* rows:
order statistics come from histograms of fixed bins (of a distance 2.2 %) and moments from partial sums, so no cell is
ever gathered in one task, however many rows it has. A document is rejected if its squared Mahalanobis distance is
over the cut.

Null text has no words and fails the base rules; null language or source is a value of its own; repeated rows are rows
each; a cell of which no row passes the base rules has no estimate and rejects by the base rules alone; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, materialize, small_side
from .wordstream import BLOCK, U, Words, blocks, covered, giving_back, mix, rows_of

SYMBOLS = b"#*$%&|<>"
#: Statistic -> least standard deviation it is given, so that a constant statistic doesn't make a cell singular.
FEATURES = {"log_words": 0.5, "word_length": 0.35, "symbols": 0.04, "punctuation": 0.06, "capitals": 0.06, "digits": 0.06, "dup_lines": 0.25, "repeats": 0.15}
BINS_PER_OCTAVE = 32
#: Rows whose distances are taken at once.
ROWS = 2048

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_IS_SYMBOL = _table(SYMBOLS)
_IS_CAPITAL = _table(bytes(range(0x41, 0x5B)))
_IS_DIGIT = _table(bytes(range(0x30, 0x3A)))
_IS_MARK = _table(bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum()))
_IS_LEAD = np.array([(c & 0xC0) != 0x80 and c not in (0x20, *range(0x09, 0x0E)) for c in range(256)], np.int64)


def dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier one)."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (n x 5) and transformed statistics (n x features) of a block of texts."""
    w = Words(texts)
    raw = np.frombuffer(w.data, np.uint8)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags[raw])))
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    n = np.diff(w.first)
    chars, symbols, capitals, digits, marks = map(per_text, (_IS_LEAD, _IS_SYMBOL, _IS_CAPITAL, _IS_DIGIT, _IS_MARK))
    lines = np.array([dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
    at, hashes = w.windows(8)
    _, which, times = np.unique(mix(hashes + w.doc[at].astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = covered(at[times[which] > 1], 8, len(w.starts))
    total = np.concatenate(([0], np.cumsum(again)))
    repeats = total[w.first[1:]] - total[w.first[:-1]]
    share = lambda part, whole, more: np.sqrt(part / (whole + more))
    stats = np.stack([np.log1p(n), (chars + 300) / (n + 50), share(symbols, chars, 200), share(marks, chars, 200), share(capitals, chars, 200), share(digits, chars, 200), share(lines[:, 1], lines[:, 0], 4), share(repeats, n, 50)], axis=1)
    return np.stack([n, chars, symbols, lines[:, 1], repeats], axis=1), stats


def _measured(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for rows in blocks(rows_of(batch, "doc_id", "lang", "source"), BLOCK):
            ids, langs, sources, texts = map(list, zip(*rows, strict=True))
            counts, stats = measure(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sources, pa.string()), *(pa.array(c) for c in counts.T), *(pa.array(s) for s in stats.T)],
                names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES],
            )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts, statistics and the base verdict of every document."""
    out = _rows(docs).mapInArrow(giving_back(_measured), f"doc_id long, lang string, source string, {_COUNTS}, " + ", ".join(f"{f} double" for f in FEATURES))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def chi_square(p: int, share: float) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * math.sqrt(2 / (9 * p))) ** 3


P = len(FEATURES)
_FLOOR = np.array(list(FEATURES.values()))
_UPPER = np.triu_indices(P)


def _cells_of(batch, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's cell, and its statistics."""
    coded = batch.column("cell").dictionary_encode()
    ids = np.array([number[c] for c in coded.dictionary.to_pylist()], np.int64)
    return ids[coded.indices.to_numpy()], np.stack([batch.column(f).to_numpy() for f in FEATURES], 1)


class Cells:
    """Passes over ``rows`` (cell, features) for the cells ``names``, whose models are arrays on the driver: as many as
    there are cells, which the caller bounds."""

    def __init__(self, rows: DataFrame, names: list[str]):
        self.rows, self.names = rows, names
        self.sc = rows.sparkSession.sparkContext
        self.number = self.sc.broadcast({c: i for i, c in enumerate(names)})

    def quantiles(self, values, width: int, share: float) -> np.ndarray:
        """(cells, width): the bin that holds the quantile of each of the ``width`` binned values that
        ``values(cell numbers, statistics)`` gives of a row."""
        number = self.number

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                cell, x = _cells_of(batch, number.value)
                bins = values(cell, x).astype(np.int64)
                for k in range(width):
                    keys, n = np.unique(np.stack((cell, bins[:, k])), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(np.full(len(n), k)), pa.array(keys[1]), pa.array(n)], names=["cell", "k", "bin", "n"])

        per_bin = self.rows.mapInArrow(run, "cell long, k long, bin long, n long").groupBy("cell", "k", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("cell", "k")
        ranked = per_bin.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        out = np.zeros((len(self.names), width))
        for r in ranked.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("cell", "k").agg(F.min("bin").alias("bin")).collect():
            out[r["cell"], r["k"]] = r["bin"]
        return out

    def moments(self, values, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, width) counts, means and second moments of the vectors that ``values(cell numbers, statistics)``
        gives: for each of ``width`` kinds the vectors and a mask of the rows that count."""
        number = self.number

        def packed(cell: np.ndarray, kind: np.ndarray, sums: np.ndarray):
            import pyarrow as pa

            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(kind), lists], names=["cell", "k", "sums"])

        def added(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            return key[order][new], np.add.reduceat(rows[order], new) if len(new) else rows

        def partial(batches: Iterator) -> Iterator:
            for batch in batches:
                cell, x = _cells_of(batch, number.value)
                for k, (v, ok) in enumerate(values(cell, x)):
                    v = v[ok]
                    keys, sums = added(cell[ok], np.concatenate((np.ones((len(v), 1)), v, (v[:, :, None] * v[:, None, :])[:, _UPPER[0], _UPPER[1]]), 1))
                    yield packed(keys, np.full(len(keys), k), sums)

        def whole(batches: Iterator) -> Iterator:
            key, sums = np.zeros(0, np.int64), np.zeros((0, 1 + P + len(_UPPER[0])))
            for batch in batches:  # what is held is a row for each cell and kind
                more = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1)
                key, sums = added(np.concatenate((key, batch.column("cell").to_numpy() * width + batch.column("k").to_numpy())), np.concatenate((sums, more)))
            yield packed(key // width, key % width, sums)

        kinds = "cell long, k long, sums array<double>"
        n, mean, second = np.zeros((len(self.names), width)), np.zeros((len(self.names), width, P)), np.zeros((len(self.names), width, P, P))
        for r in self.rows.mapInArrow(partial, kinds).repartition("cell").mapInArrow(whole, kinds).collect():
            c, k, sums = r["cell"], r["k"], np.array(r["sums"])
            n[c, k], mean[c, k] = sums[0], sums[1 : P + 1] / sums[0]
            second[c, k][_UPPER] = sums[P + 1 :] / sums[0]
            second[c, k].T[_UPPER] = sums[P + 1 :] / sums[0]
        return n, mean, second


@dataclass
class Models:
    """Means (cells, width, P), inverse covariances and logs of the covariances' determinants."""

    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, cov: np.ndarray) -> Models:
        cov = cov + np.diag(_FLOOR**2)
        return cls(mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1])

    def distances(self, cell: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.mean.shape[1]))
        for s in range(0, len(x), ROWS):
            c = cell[s : s + ROWS]
            off = x[s : s + ROWS, None, :] - self.mean[c]
            out[s : s + ROWS] = np.einsum("nki,nkij,nkj->nk", off, self.inverse[c], off, optimize=True)
        return out

    def best(self) -> Models:
        at = np.arange(len(self.mean)), self.logdet.argmin(1)
        return Models(self.mean[at][:, None], self.inverse[at][:, None], self.logdet[at][:, None])


def _bins(distance: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(distance + 2.0**-20) * BINS_PER_OCTAVE)


def _edge(bins: np.ndarray) -> np.ndarray:
    return 2.0 ** ((bins + 1) / BINS_PER_OCTAVE)


def _start(cells: Cells) -> Models:
    """What concentration begins with: classical, medians and spreads, signs, tangents."""
    fine = _FLOOR / 16
    centre = (cells.quantiles(lambda _, x: np.floor(x / fine), P, 0.5) + 0.5) * fine
    spread = (cells.quantiles(lambda c, x: np.floor(np.abs(x - centre[c]) / fine), P, 0.5) + 0.5) * fine * 1.4826

    def vectors(cell: np.ndarray, x: np.ndarray) -> list:
        z, ok = (x - centre[cell]) / (spread[cell] + _FLOOR), np.ones(len(x), bool)
        return [(x, ok), (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9), ok), (np.tanh(z), ok)]

    _, mean, second = cells.moments(vectors, 3)
    scale = spread[:, :, None] * spread[:, None, :]
    middle = mean[:, :, :, None] * mean[:, :, None, :]
    covs = [second[:, 0] - middle[:, 0], scale * np.eye(P), scale * second[:, 1] * P, scale * (second[:, 2] - middle[:, 2])]
    return Models.of(np.stack((mean[:, 0], centre, centre, centre), 1), np.stack(covs, 1))


def _step(cells: Cells, models: Models, h: float) -> Models:
    """One concentration step of every model: mean and covariance of the share ``h`` of least distance."""
    width = models.mean.shape[1]
    cut = _edge(cells.quantiles(lambda c, x: _bins(models.distances(c, x)), width, h))

    def inner(cell: np.ndarray, x: np.ndarray) -> list:
        return [(x, ok) for ok in (models.distances(cell, x) <= cut[cell]).T]

    _, mean, second = cells.moments(inner, width)
    return Models.of(mean, second - mean[:, :, :, None] * mean[:, :, None, :])


def least_determinant(cells: Cells, h: float, most_steps: int = 30) -> Models:
    """The model of each cell: see the module."""
    models = _start(cells)
    for _ in range(2):
        models = _step(cells, models, h)
    models = models.best()
    for _ in range(most_steps):
        after = _step(cells, models, h)
        fell = (models.logdet - after.logdet).max(initial=0)
        models = after
        if fell < 1e-2:
            break
    return models


def _scale(cells: Cells, models: Models) -> np.ndarray:
    """What puts each cell's distances on the chi-square scale by their median; 1 at least."""
    return np.maximum(1.0, _edge(cells.quantiles(lambda c, x: _bins(models.distances(c, x)), 1, 0.5)) / chi_square(P, 0.5))


def _fit_cells(cells: Cells, h: float) -> list[tuple]:
    """(cell, mean, inverse, scale) of the reweighted estimates."""
    raw = least_determinant(cells, h)
    most = _scale(cells, raw) * chi_square(P, 0.975)
    _, mean, second = cells.moments(lambda c, x: [(x, raw.distances(c, x)[:, 0] <= most[c, 0])], 1)
    final = Models.of(mean, second - mean[:, :, :, None] * mean[:, :, None, :])
    scale = _scale(cells, final)
    return [(c, final.mean[i, 0].tolist(), final.inverse[i, 0].ravel().tolist(), float(scale[i, 0])) for i, c in enumerate(cells.names)]


def _distance() -> Column:
    """Squared distance of a row's features under ``mean`` and ``inverse``."""
    off = F.zip_with(F.array(*FEATURES), "mean", lambda x, m: x - m)
    return F.aggregate(F.transform(off, lambda x, i: x * F.aggregate(F.zip_with(off, F.slice("inverse", i * P + 1, P), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)), F.lit(0.0), lambda s, v: s + v)


def _pooled(stats: DataFrame, min_cell: int) -> DataFrame:
    """(lang, source, cell, fits): the cell that judges a pair's documents, and the cells its rows are fitted in."""
    text = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    n = stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    of_lang, whole = Window.partitionBy("lang"), Window.partitionBy(F.lit(1))
    cell, lang, every = F.concat_ws("\x1f", F.lit("pair"), text("lang"), text("source")), F.concat_ws("\x1f", F.lit("lang"), text("lang")), F.lit("all")
    own = n.withColumn("m", F.sum("n").over(of_lang)).withColumn("cell", F.when(F.col("n") >= min_cell, cell).when(F.col("m") >= min_cell, lang).otherwise(every))
    need = own.withColumn("lang_used", F.max((F.col("cell") == lang).cast("int")).over(of_lang) > 0).withColumn("all_used", F.max((F.col("cell") == every).cast("int")).over(whole) > 0)
    fits = F.array_compact(F.array(F.when(F.col("n") >= min_cell, cell), F.when(F.col("lang_used"), lang), F.when(F.col("all_used"), every)))
    return materialize(need.select("lang", "source", "cell", fits.alias("fits")), "quality-pairs")


def _same_pair(a: str = "lang", b: str = "source") -> Column:
    return F.col(a).eqNullSafe(F.col("__l")) & F.col(b).eqNullSafe(F.col("__s"))


def fit(stats: DataFrame, h: float = 0.75, min_cell: int = 40, most_cells: int = 20_000) -> DataFrame:
    """(lang, source, mean, inverse, scale) of every pair of language and source of ``stats`` (written statistics).

    ``h``: share of a cell that carries its estimate. ``min_cell``: five rows for each statistic, the least that
    the literature gives for such an estimate. ``scale`` puts a cell's distances on the chi-square scale by their
    median. Cells are fitted about ``most_cells`` at a time, which bounds what the driver and a task hold.
    """
    spark = stats.sparkSession
    pairs = _pooled(stats, min_cell)
    sides = small_side(pairs.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), "fits"), most_cells)
    rows = stats.filter(~F.col("base_failed")).join(sides, _same_pair()).select(F.explode("fits").alias("cell"), *FEATURES)
    rows = materialize(rows, "quality-rows")
    every = materialize(pairs.select(F.explode("fits").alias("cell")).distinct(), "quality-cells")
    parts = -(-every.count() // most_cells)
    models, part = None, lambda n: F.pmod(F.xxhash64("cell"), F.lit(max(1, parts))) == n
    for n in range(max(1, parts)):
        names = sorted(r["cell"] for r in every.filter(part(n)).collect())
        found = spark.createDataFrame(_fit_cells(Cells(rows.filter(part(n)) if parts > 1 else rows, names), h) if names else [], "cell string, mean array<double>, inverse array<double>, scale double")
        models = found if models is None else models.union(found)
    return materialize(pairs.join(models, "cell").select("lang", "source", "mean", "inverse", "scale"), "quality-models")


def reject_outliers(docs: DataFrame, h: float = 0.75, tail: float = 1e-4, slack: float = 1.2, min_cell: int = 40, most_cells: int = 20_000) -> DataFrame:
    """Per document: counts, base verdict, squared distance and the final verdict ``kept``.

    A scaled squared distance is compared with ``slack`` times the chi-square quantile at 1 - ``tail``.
    """
    stats = materialize(statistics(docs), "quality-stats")
    models = fit(stats, h, min_cell, most_cells).withColumnsRenamed({"lang": "__l", "source": "__s"})
    scored = stats.join(small_side(models, most_cells), _same_pair(), "left").withColumn("distance2", _distance() / F.col("scale"))
    verdict = ~F.col("base_failed") & (F.col("distance2") <= slack * chi_square(len(FEATURES), 1 - tail))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(verdict, ~F.col("base_failed")).alias("kept"), "distance2")


def keep_good(docs: DataFrame, h: float = 0.75, tail: float = 1e-4, slack: float = 1.2, min_cell: int = 40, most_cells: int = 20_000) -> DataFrame:
    """``docs`` without the rejected documents; all columns stay.

    Each row is judged by its own text, so null and repeated doc_ids make no difference: the models go to every task
    and a second scan measures and filters, without a shuffle of the texts. Above ``most_cells`` pairs of language and
    source their models are joined to the rows instead.
    """
    models = fit(materialize(statistics(docs), "quality-stats"), h, min_cell, most_cells)
    cut = slack * chi_square(len(FEATURES), 1 - tail)
    schema = docs.schema
    own = {c: c if schema[c].dataType.simpleString() == "string" else f"__{c}" for c in ("lang", "source", "text")}  # no text goes twice
    rows = docs.select("*", *(F.col(c).cast("string").alias(o) for c, o in own.items() if c != o))
    extra, text = [own["lang"], own["source"]], own["text"]
    known = None
    if fits(models, most_cells):
        known = docs.sparkSession.sparkContext.broadcast({(r["lang"], r["source"]): (np.array(r["mean"]), np.array(r["inverse"]).reshape(len(FEATURES), -1), r["scale"]) for r in models.collect()})
    else:
        keyed = models.select(F.col("lang").alias("__ml"), F.col("source").alias("__ms"), F.struct("mean", "inverse", "scale").alias("__m"))
        rows = rows.join(keyed, F.col(own["lang"]).eqNullSafe(F.col("__ml")) & F.col(own["source"]).eqNullSafe(F.col("__ms")), "left").drop("__ml", "__ms")
        extra = [*extra, "__m"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, keep = 0, []
            for part in blocks(rows_of(batch, *extra, text=text), BLOCK):
                counts, stats = measure([r[-1] for r in part])
                for (lang, source, *joined, _), (n, *_, again), x in zip(part, counts.tolist(), stats, strict=True):
                    model = known.value.get((lang, source)) if known is not None else joined[0] and (np.array(joined[0]["mean"]), np.array(joined[0]["inverse"]).reshape(len(x), -1), joined[0]["scale"])
                    good = n >= 20 and 100 * again <= 30 * n
                    if good and model:
                        off = x - model[0]
                        good = off @ model[1] @ off <= cut * model[2]
                    keep.append(bool(good))
                yield batch.slice(at, len(part)).select(schema.names).filter(pa.array(keep, pa.bool_()))
                at, keep = at + len(part), []

    return rows.mapInArrow(giving_back(run), schema)
