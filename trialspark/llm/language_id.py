"""Language identification of eligibility texts with interpolated Kneser-Ney character models, one per language.

Character 4-grams are counted over the whole corpus by Spark. A gram packs four letter classes of six bits, so a
language has at most 2**24 of them whatever the corpus; that bound is what lets the finished models be broadcast. The
models are sorted arrays of packed grams with one log probability per language, and dense tables for what backs off.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.session import checkpointed

RUN_CHARS = 1 << 18
BITS, ORDER = 6, 4
UNKNOWN = "und"
_classes: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 no letter, 1-26 a-z, 27-63 other letters by remainder."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x30000):
            if chr(cp).isalpha():
                table[cp] = cp - 96 if 97 <= cp < 123 else 27 + cp % 37
        _classes.append(table)
    return _classes[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of lower-cased texts and the row of each; other characters than letters make one blank."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + ORDER - 1 for t in low], np.int64)
    blank = "\n" * (ORDER - 1)
    codes = letter_classes()[np.frombuffer(("".join(blank + t for t in low)).encode("utf-32-le", "surrogatepass"), np.uint32)]
    lead = np.zeros(len(codes), bool)
    starts = np.cumsum(size) - size
    for j in range(ORDER - 1):
        lead[starts + j] = True
    kept = (codes > 0) | lead
    kept[1:] |= codes[:-1] > 0
    row, own, codes = np.repeat(np.arange(len(low)), size)[kept], ~lead[kept], codes[kept].astype(np.uint32)
    packed = codes.copy()
    for j in range(1, ORDER):
        packed[j:] |= codes[:-j] << np.uint32(BITS * j)
    return packed[own], row[own]


@dataclass
class LanguageModels:
    """Log probabilities by language: sorted ``keys`` of 4-grams seen in any language with ``top`` (grams x languages);
    ``lower`` (2**18 x languages) for every 3-gram and ``weight`` (2**18 x languages) for backing off from a context."""

    languages: list[str]
    keys: np.ndarray
    top: np.ndarray
    lower: np.ndarray
    weight: np.ndarray
    _after: np.ndarray = field(init=False, repr=False)  # for each context, the classes that follow it, as 64 bits
    _start: np.ndarray = field(init=False, repr=False)  # and where its grams begin among the sorted keys

    def __post_init__(self):
        contexts = self.keys >> BITS
        self._after = np.zeros(1 << BITS * (ORDER - 1), np.uint64)
        np.bitwise_or.at(self._after, contexts, np.uint64(1) << (self.keys & (1 << BITS) - 1).astype(np.uint64))
        self._start = np.searchsorted(contexts, np.arange(len(self._after))).astype(np.int32)

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        context, bit = packed >> BITS, np.uint64(1) << (packed & (1 << BITS) - 1).astype(np.uint64)
        after = self._after[context]
        at = self._start[context] + np.bitwise_count(after & bit - np.uint64(1))
        miss = np.flatnonzero(after & bit == 0)
        out = self.top[np.minimum(at, len(self.keys) - 1)] if len(self.keys) else np.zeros((len(packed), len(self.languages)), np.float32)
        if len(miss):
            out[miss] = self.weight[context[miss]] + self.lower[packed[miss] & (1 << BITS * (ORDER - 1)) - 1]
        return out


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated Kneser-Ney over sorted packed 4-grams: log p of ``keys``, of every 3-gram, and log back-off weights.

    The highest order uses counts, lower orders the number of distinct one-character extensions to the left; the lowest
    backs off to a uniform distribution over the classes. Unseen contexts back off with weight one.
    """
    levels = [(keys.astype(np.int64), counts.astype(np.float64))]
    for n in range(ORDER - 1, 0, -1):
        grams_n, types = np.unique(levels[-1][0] & (1 << BITS * n) - 1, return_counts=True)
        levels.append((grams_n, types.astype(np.float64)))
    dense, weight = np.full(1, 1.0), None
    for n, (own, c) in enumerate(reversed(levels), start=1):
        d, contexts = _discount(c), own >> BITS
        size = 1 << BITS * (n - 1)
        total = np.bincount(contexts, weights=c, minlength=size)
        kinds = np.bincount(contexts, minlength=size)
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        # p(lower order) of a gram drops its first class
        below = np.full(1 << BITS, 1 / (1 << BITS)) if n == 1 else dense
        if n == ORDER:
            p = np.maximum(c - d, 0) / total[contexts] + weight[contexts] * below[own & len(below) - 1]
            return np.log(p), np.log(dense), np.log(weight)
        every = np.arange(1 << BITS * n)
        dense = weight[every >> BITS] * below[every & len(below) - 1]
        dense[own] += np.maximum(c - d, 0) / total[contexts]
    raise AssertionError


def count_grams(eligibilities: DataFrame, *, text: str = "criteria", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): character 4-gram counts over all texts with a language."""

    def count(batches):
        for batch in batches:
            for rows in _runs(batch):
                packed, row = grams(rows.column(0).to_pylist())
                names, code = np.unique(np.array(rows.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
                of = code[row]
                for i, name in enumerate(names):
                    values, n = np.unique(packed[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int32)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    own = eligibilities.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    return own.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _runs(batch: pa.RecordBatch, limit: int = RUN_CHARS):
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def fit_language_models(eligibilities: DataFrame, *, text: str = "criteria", lang: str = "lang") -> LanguageModels:
    """Models of every language that labels a text with a letter; counts cover all given rows.

    Rows with a null text or language teach nothing; languages are ordered by name. The counts of one language at a
    time, at most 2**24 numbers, reach the driver. Runs a Spark job that writes the counts to the shared folder.
    """
    counted = checkpointed(count_grams(eligibilities, text=text, lang=lang))
    languages = [r.lang for r in counted.select("lang").distinct().orderBy("lang").collect()]
    parts = []
    for name in languages:
        got = counted.where(F.col("lang") == name).select("gram", "n").toArrow()
        g, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
        order = np.argsort(g)
        parts.append((g[order], *kneser_ney(g[order], n[order])))
    low = 1 << BITS * (ORDER - 1)
    keys = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.int64)
    models = LanguageModels(languages, keys, np.zeros((len(keys), len(parts)), np.float32), np.zeros((low, len(parts)), np.float32), np.zeros((low, len(parts)), np.float32))
    for i, (g, p, lower, weight) in enumerate(parts):
        models.lower[:, i], models.weight[:, i] = lower, weight
        models.top[:, i] = weight[keys >> BITS] + lower[keys & low - 1]
        models.top[np.searchsorted(keys, g), i] = p
    return models


def score_languages(eligibilities: DataFrame, models: LanguageModels, *, text: str = "criteria", evidence: int = 20) -> DataFrame:
    """``eligibilities``, all columns under new names ``c0..``, with the best language of each whole text.

    Appends ``language`` (lowest cross-entropy per character, ties to the first name; ``und`` for a text that is null or
    has no letter, or without any model), ``cross_entropy`` (nats, null for ``und``), ``n_grams`` and ``score`` (0 to 1:
    the share of the best language when each is weighted by its likelihood over at most ``evidence`` characters).
    """
    own = eligibilities.toDF(*(f"c{i}" for i in range(len(eligibilities.columns))))
    at, names_in, shared = eligibilities.columns.index(text), own.columns, eligibilities.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        known = shared.value
        for batch in batches:
            for rows in _runs(batch.select([at, *(i for i in range(batch.num_columns) if i != at)])):
                back = rows.select([*range(1, at + 1), 0, *range(at + 1, rows.num_columns)])
                n = rows.num_rows
                packed, row = grams(rows.column(0).to_pylist())
                edge = np.searchsorted(row, np.arange(n + 1))
                full = np.flatnonzero(np.diff(edge)) if known.languages else np.zeros(0, np.int64)
                best, entropy, share = np.full(n, -1), np.full(n, np.nan), np.zeros(n)
                if len(full):
                    sums = np.add.reduceat(known.log_probabilities(packed), edge[full], axis=0, dtype=np.float64)
                    size = np.diff(edge)[full]
                    each = -sums / size[:, None]
                    best[full], entropy[full] = each.argmin(1), each.min(1)
                    share[full] = 1 / np.exp((each.min(1)[:, None] - each) * np.minimum(size, evidence)[:, None]).sum(1)
                names = [known.languages[i] if i >= 0 else UNKNOWN for i in best]
                yield pa.RecordBatch.from_arrays(
                    [*back.columns, pa.array(names, pa.string()), pa.array(entropy, mask=best < 0), pa.array(np.diff(edge), pa.int64()), pa.array(share)],
                    [*names_in, "language", "cross_entropy", "n_grams", "score"])

    fields = [*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema), "language string", "cross_entropy double", "n_grams bigint", "score double"]
    return own.mapInArrow(score, ", ".join(fields))


def calibrate(scored: DataFrame, label: str | None = None, least: int = 20) -> dict[str, tuple[float, float, float]]:
    """By language: median cross-entropy, its spread, and its spread times the root of the length.

    With ``label`` only texts whose label is the predicted language count. Spreads are taken from the better-fitting half
    (median less 16th percentile), by length too where ``least`` texts have it, so that what fits badly does not widen its
    own limit while it is less than half of a language.
    """
    e = F.col("cross_entropy")
    sure = scored.where(e.isNotNull() if label is None else e.isNotNull() & (F.col(label) == F.col("language")))
    by = sure.select("language", e, F.floor(F.log2(F.least("n_grams", F.lit(400)))).cast("int").alias("size")).rollup("language", "size")
    found = by.agg(F.count("*").alias("n"), F.percentile_approx(e, [0.16, 0.5], 10_000).alias("q")).where("language IS NOT NULL").collect()
    whole = {r.language: r.q for r in found if r["size"] is None}
    out = {}
    for name, (low, mid) in whole.items():
        wide = [(max(0.0, r.q[1] - mid) + r.q[1] - r.q[0]) * 2 ** (r["size"] / 2) for r in found if r.language == name and r["size"] is not None and r.n >= least]
        out[name] = (mid, mid - low, max(wide, default=0.0))
    return out


def _by_language(values: dict[str, float]):
    return F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])[F.col("language")]


def rejected(limits: dict[str, tuple[float, float, float]], tolerance: float = 8.0):
    """Whether a scored text fits its best language so badly that it belongs to none of them.

    A text without a language is rejected. Another one is if its cross-entropy exceeds its language's median by
    ``tolerance`` times the spread that texts of its length have, and is also nearer to that of guessing each character
    blindly than to the median. So odd but readable texts stay. A language without limits has the widest of the others;
    without any, only texts without a language are rejected.
    """
    if not limits:
        return F.col("cross_entropy").isNull()
    m, s, u = (F.coalesce(_by_language({k: float(v[i]) for k, v in limits.items()}), F.lit(float(max(v[i] for v in limits.values())))) for i in range(3))
    blind = float(np.log(1 << BITS))
    limit = F.greatest(m + tolerance * F.greatest(s, u / F.sqrt("n_grams")), (m + blind) / 2)
    return F.coalesce(F.col("cross_entropy") > limit, F.lit(True))


def identify_language(eligibilities: DataFrame, models: LanguageModels, *, key: str = "nct_id", text: str = "criteria") -> DataFrame:
    """``key``, ``language``, ``cross_entropy``, ``n_grams`` and ``score`` of every row; see ``score_languages``.

    Null, empty and letterless texts give ``und`` with score 0; repeated rows are scored alone; extra columns are ignored.
    """
    scored = score_languages(eligibilities.select(F.col(key).alias("k"), F.col(text).alias("t")), models, text="t")
    return scored.select(F.col("c0").alias(key), "language", "cross_entropy", "n_grams", "score")
