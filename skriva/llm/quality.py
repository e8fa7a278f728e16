"""Per-document text statistics and how far they lie from prose.

Each document becomes a vector of statistics (`STATISTICS`). Per language there is a mean and a covariance of prose, and the
Mahalanobis distance to them says how unlike prose a document is; each statistic's share of it says why. A document is
reported if its distance exceeds the cutoff, and by nothing else.

The model starts from labelled rows, at most `LABELLED` documents: their prose gives the first mean and covariance of
each language. Concentration steps then take again and again the nearest documents of all, as many as the labels call
prose, so the moments come from the whole corpus and not from the labels. The cutoff is the distance that parts the
labelled prose from the other labelled documents with the fewest errors. Without labels the steps start from the
coordinate medians, trust half of the documents, and the cutoff is a quantile of that half's distances.

Some statistics speak against prose on one side only (`SIDE`): a document with fewer symbols than prose has is no less
prose. Deviations to the other side count as none.

Languages are told by script and function words. Texts of any other language, and texts without any language, are
compared with the prose of all languages together, leaving out the share of function words, which says nothing there.

Moments and histograms come from all documents: a task adds up its own rows per language and bin of distance, the sums are
added by key, and the driver gets some thousand numbers per language.

Front matter is left out. Null and blank texts have no statistics and are never reported; null and repeated labels,
labels of unknown documents and a tie of votes count for nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriva.functions.text import is_blank
from skriva.session import cut

STATISTICS = (
    "log_words",
    "word_length",
    "symbol_ratio",
    "digit_ratio",
    "upper_ratio",
    "garbled_ratio",
    "common_ratio",
    "closed_lines",
    "log_line_length",
    "bullet_share",
    "table_share",
    "repeat_share",
    "long_token_share",
    "sentence_share",
)
#: The side on which a statistic speaks against prose: 1 above the mean, -1 below it, 0 both.
SIDE = np.array([0, 0, 1, 1, 1, 1, -1, -1, 0, 1, 1, 1, 1, -1])
#: A standard deviation that is added to each statistic's own, so that a constant one doesn't count as infinitely sure.
FLOOR = np.array([1.5, 0.9, 0.02, 0.03, 0.3, 0.002, 0.05, 0.25, 0.5, 0.1, 0.08, 0.08, 0.1, 0.08])
#: Bound on the labelled documents that the model starts from and the cutoff is taken from.
LABELLED = 20_000
#: The least number of labelled documents for a cutoff, and of labelled prose documents for a language of its own.
LEAST_LABELLED, LEAST_PROSE = 40, 20
#: Share of the documents that the steps trust where no labels tell, and the number of steps.
TRUSTED, STEPS = 0.5, 3
#: Without labels a document is an outlier beyond this quantile of the trusted half's squared distances, times `SLACK`.
QUANTILE, SLACK = 0.99, 9.0
OTHER = "other"

# Function words of each language.
FUNCTION_WORDS = {
    "en": frozenset(
        "a about after all an and any are as at be because been before both but by can could did do does each for from had has have he her his how i if in into is it its may might more most must my no nor not of off on one only or other our out over own same she should since so some such than that the their them then there these they this those through to too under until up us very was we were what when where which while who whom why will with would yet you your".split()
    ),
    "de": frozenset(
        "aber alle als also am an auch auf aus bei bin bis da dann das dass dein dem den denn der des dich die dies diese dieser dir doch du durch ein eine einem einen einer eines er es euch für gegen hat haben hatte hier ich ihm ihn ihr im in ist ja jede kann kein keine können man mein mehr mich mir mit muss nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so über um und uns unser unter vom von vor war waren warum was weil wenn wer werden wie wieder wir wird wo wurde zu zum zur zwischen".split()
    ),
}
#: Least share of function words by which a language is told.
TOLD = 0.1
_JA = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]")
_HIRAGANA = re.compile(r"[ぁ-ん]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_FRONT = re.compile(r"\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_BULLET = re.compile(r"(?:[-*+•・◦‣–]|\(?\d{1,3}[.)])\s+|[•・◦‣]|\[[ xX]\]")
_COLUMNS = re.compile(r"\S {2,}\S.* {2,}\S|^\S+ {3,}\S+$|^[^\s,]+(?:,[^\s,]*){2,}$")
_SPEAKER = re.compile(r"\*\*[^*\n]{1,20}:\*\*\s*|>\s*")
_QUOTED = re.compile(r"`[^`]*`|\S*[/\\=]\S*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]*]*\s+|(?<=[。！？])[」』）]*\s*")
_STOPS, _CLOSERS = ".!?。！？…", "\"'”’)]」』）*_`"
#: Letters and marks that come in rows where UTF-8 was read as another encoding, and what stands for no character.
_GARBLED = re.compile(r"[\x80-\x9f\ufffd]|[ÂÃâãäåæçèéêï][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_LONG = re.compile(r"[!-~]{40,}")


def _classes() -> np.ndarray:
    """Of each character of the basic plane: 0 other, 1 lower or uncased letter, 2 upper letter, 3 digit, 4 space, 5 usual mark."""
    out = np.zeros(65536, np.int64)
    for i in range(65536):
        c = chr(i)
        out[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,!?'\"()-:;。、「」！？・（）’“”" else 0
    return out


_CLASS: list[np.ndarray] = []


def _count_classes(s: str) -> list[int]:
    if not _CLASS:
        _CLASS.append(_classes())
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_CLASS[0][np.minimum(codes, 65535)], minlength=6).tolist()


def is_closed(s: str) -> bool:
    """Does `s` end like a sentence?"""
    if s[-1] in _CLOSERS:
        s = s.rstrip(_CLOSERS)
    return s[-1:] != "" and s[-1] in _STOPS


def reads(s: str, ja: bool) -> bool:
    """Is `s` made of words, leaving out quoted code and paths?"""
    if "/" in s or "`" in s or "=" in s:
        s = _QUOTED.sub("", s)
    n = len(s)
    if ja:
        k = len(_JA.findall(s))
        if k > 0.25 * n:
            return k >= 4 and len(_HIRAGANA.findall(s)) >= 0.08 * k
    words = _WORD.findall(s)
    return len(words) >= 3 and sum(map(len, words)) >= 0.6 * n


def is_table_row(x: str) -> bool:
    """Cells parted by bars, tabs, commas without blanks, or rows of blanks; a line that ends like a sentence is none."""
    if x.count("|") > 1:
        return True
    return (x.count("\t") > 1 or ("  " in x or "," in x and ", " not in x) and bool(_COLUMNS.search(x))) and not is_closed(x)


def statistics(text: str) -> tuple[str, list[float]] | None:
    """The language and the statistics of a text, or None where there is nothing but white space."""
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    if body.lstrip()[:3] == "---":
        rest = _FRONT.sub("", body, count=1)
        body = rest if rest and not rest.isspace() else body
    lines = [x for x in map(str.strip, body.splitlines()) if x]
    if not lines:
        return None
    words = _WORD.findall(body)
    low = list(map(str.lower, words))
    plain = body.isascii()
    many_ja = 0 if plain else len(_JA.findall(body))
    ja, count = many_ja > 0, max(1, len(words))
    known = {k: sum(map(w.__contains__, low)) for k, w in FUNCTION_WORDS.items()}
    most = max(known, key=known.get)
    lang = "ja" if many_ja > 0.15 * len(body) else most if known[most] >= TOLD * count else OTHER
    seen: set[str] = set()
    total = bullets = tables = repeats = sentences = closed = 0
    block: list[str] = []

    def close() -> None:
        nonlocal sentences, repeats
        if not block:
            return
        joined = block[0]
        for x in block[1:]:
            joined += x if ja and (_JA.match(x) or _JA.match(joined[-1])) else " " + x
        block.clear()
        for s in _SENTENCE.split(joined):
            if not s:
                continue
            if s in seen:
                repeats += len(s)
            else:
                seen.add(s)
                if is_closed(s) and reads(s, ja):
                    sentences += len(s)

    fenced = False
    for x in lines:
        c = x[0]
        if c in "`~" and x[:3] in ("```", "~~~"):
            close()
            fenced = not fenced
            continue
        if c == "#" and not fenced and x.lstrip("#")[:1] == " ":
            close()
            continue
        n = len(x)
        total += n
        closed += is_closed(x)
        if fenced or is_table_row(x):
            close()
            tables += 0 if fenced else n
            repeats += n if x in seen else 0
            seen.add(x)
        elif bullet := _BULLET.match(x):
            close()
            bullets += n
            if rest := x[bullet.end() :]:
                block.append(rest)
                close()
        else:
            block.append((_SPEAKER.sub("", x) or x) if c in "*>" else x)
    close()
    total, chars = max(total, 1), len(body)
    other, lower, upper, digits, _, _ = _count_classes(body)
    values = [
        math.log1p(len(words)),
        5.0 if lang == "ja" else min(20.0, sum(map(len, words)) / count),
        other / chars,
        digits / chars,
        upper / max(1, lower + upper),
        0.0 if plain else len(_GARBLED.findall(body)) / chars,
        len(_HIRAGANA.findall(body)) / max(1, many_ja) if lang == "ja" else known[most] / count,
        closed / len(lines),
        math.log1p(total / len(lines)),
        bullets / total,
        tables / total,
        min(1.0, repeats / total),
        sum(map(len, _LONG.findall(body))) / chars,
        min(1.0, sentences / total),
    ]
    return lang, values


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language, stats (array of DOUBLE in the order of `STATISTICS`): one row per document that has text."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, language string, stats array<double>"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(s) if s else None for s in batch.column(1).to_pylist()]
            rows = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_pydict(
                {
                    key: batch.column(0).take(pa.array(rows, pa.int64())),
                    "language": pa.array([found[i][0] for i in rows], pa.string()),
                    "stats": pa.array([found[i][1] for i in rows], pa.list_(pa.float64())),
                }
            )

    return df.select(key, text).where(~is_blank(F.col(text))).mapInArrow(go, schema)


# The bins of squared distances, by their logarithm.
_BINS, _PER_UNIT, _LOW = 48, 3, -3.0
_K = len(STATISTICS)
_NOT_COMMON = np.arange(_K) != STATISTICS.index("common_ratio")


def _bins(d: np.ndarray) -> np.ndarray:
    return ((np.log(np.maximum(d, 1e-9)) - _LOW) * _PER_UNIT).clip(0, _BINS - 1).astype(int)


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, _K)


def _moments(n: float, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = total / n
    return mean, squares / n - np.outer(mean, mean) + np.diag(FLOOR**2)


class Prose:
    """Mean and inverse covariance per language, those of all languages for any other, and the cutoff (squared)."""

    def __init__(self, params: dict[str, tuple[np.ndarray, np.ndarray]], pooled: tuple[np.ndarray, np.ndarray], cutoff: float = math.inf):
        self.params = {k: (m, np.linalg.inv(c)) for k, (m, c) in params.items()}
        own = np.zeros((_K, _K))
        own[np.ix_(_NOT_COMMON, _NOT_COMMON)] = np.linalg.inv(pooled[1][np.ix_(_NOT_COMMON, _NOT_COMMON)])
        self.pooled, self.cutoff = (pooled[0], own), cutoff

    def distances(self, langs: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances, and each statistic's part of them."""
        parts = np.zeros_like(x)
        for lang in np.unique(langs):
            mean, inverse = self.params.get(lang, self.pooled)
            rows = langs == lang
            z = x[rows] - mean
            z[z * SIDE < 0] = 0
            parts[rows] = z * (z @ inverse)
        return parts.sum(1), parts


#: Of the products of two statistics only one half is added up.
_UPPER = np.triu_indices(_K)


def _sums(stats: DataFrame, prose: Prose) -> dict[str, np.ndarray]:
    """Per language, for each bin of distance: number, sums and sums of products of the statistics of all documents."""
    width = 1 + _K + len(_UPPER[0])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            if not len(langs):
                continue
            x = _matrix(batch, 1)
            b = _bins(prose.distances(langs, x)[0])
            for lang in np.unique(langs):
                for bin_ in np.unique(b[langs == lang]):
                    y = x[(langs == lang) & (b == bin_)]
                    found[lang, bin_] = found.get((lang, bin_), 0) + np.concatenate([[len(y)], y.sum(0), (y.T @ y)[_UPPER]])
        if found:
            yield pa.RecordBatch.from_pydict(
                {
                    "language": np.repeat([k for k, _ in found], width),
                    "bin": pa.array(np.repeat([b for _, b in found], width), pa.int32()),
                    "i": pa.array(np.tile(np.arange(width), len(found)), pa.int32()),
                    "v": np.concatenate(list(found.values())),
                }
            )

    # A bounded number of rows per task; they are added before they reach the driver.
    added = stats.select("language", "stats").mapInArrow(go, "language string, bin int, i int, v double").groupBy("language", "bin", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in added.collect():
        out.setdefault(r["language"], np.zeros((_BINS, width)))[r["bin"], r["i"]] = r["v"]
    return out


def _upto(sums: np.ndarray, share: float) -> int:
    """The bin in which the share of the documents is reached."""
    n = sums[:, 0].cumsum()
    return int(np.searchsorted(n, share * n[-1] - 1e-9))


def _of_sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = np.zeros((_K, _K))
    squares[_UPPER] = s[_K + 1 :]
    return _moments(s[0], s[1 : _K + 1], squares + np.triu(squares, 1).T)


def _nearest(sums: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    return _of_sums(sums[: _upto(sums, share) + 1].sum(0))


def _of_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _moments(len(x), x.sum(0), x.T @ x)


def labelled_rows(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "label") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, statistics and whether most raters call it prose, of at most `LABELLED` documents, chosen by a hash of the key."""
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(F.when(F.lower(F.trim(label)) == "prose", 1.0).otherwise(0.0)).alias("_share"))
    chosen = votes.where("_share <> 0.5").orderBy(F.xxhash64(key), key).limit(LABELLED)
    rows = stats.join(chosen, key).select("language", "stats", (F.col("_share") > 0.5).alias("prose")).collect()
    return np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], float).reshape(-1, _K), np.array([r[2] for r in rows], bool)


def best_cutoff(d: np.ndarray, prose: np.ndarray) -> float:
    """The squared distance that parts prose from the rest with the fewest errors; the middle of the widest such gap."""
    order = np.argsort(d)
    d, prose = d[order], prose[order]
    # Errors of a cut before the i-th: prose from there on, and the rest up to there.
    errors = np.append(prose[::-1].cumsum()[::-1], 0) + np.append(0, (~prose).cumsum())
    edges = np.log(np.concatenate([[d[0] / 2], d, [d[-1] * 2]]).clip(1e-9))
    least = np.flatnonzero(errors == errors.min())
    at = least[np.argmax(edges[least + 1] - edges[least])]
    return float(np.exp((edges[at] + edges[at + 1]) / 2))


def fit_prose(stats: DataFrame, labels: DataFrame | None = None, key: str = "doc_id") -> Prose | None:
    """The model of prose; None for an empty table. `labels` has the key and `label` ('prose' or another)."""
    none = (np.empty(0, object), np.empty((0, _K)), np.empty(0, bool))
    langs, x, is_prose = none if labels is None else labelled_rows(stats, labels, key)
    share = {}
    start: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if is_prose.sum() >= LEAST_PROSE:
        for lang in np.unique(langs):
            own = langs == lang
            if lang != OTHER and (own & is_prose).sum() >= LEAST_PROSE:
                start[lang], share[lang] = _of_rows(x[own & is_prose]), float(is_prose[own].mean())
        pooled = _of_rows(x[is_prose])
        # Languages with too few labels of their own start from all of them.
        for r in stats.where(F.col("language") != OTHER).groupBy("language").count().collect():
            if r["language"] not in start and r["count"] >= 2 * LEAST_PROSE:
                start[r["language"]], share[r["language"]] = pooled, float(is_prose.mean())
    else:
        medians = {
            r["language"]: np.array(r["m"], float)
            for r in stats.groupBy("language").agg(F.array(*(F.percentile_approx(F.col("stats")[i], 0.5, 1000) for i in range(_K))).alias("m")).collect()
        }
        if not medians:
            return None
        own = {k: v for k, v in medians.items() if k != OTHER} or medians
        start = {k: (m, np.diag(FLOOR**2)) for k, m in own.items()}
        pooled = (np.mean(list(own.values()), 0), np.diag(FLOOR**2))
    prose = Prose(start, pooled)
    for _ in range(STEPS):
        sums = _sums(stats, prose)
        if not sums:
            return None
        near = {k: _nearest(sums[k], share.get(k, TRUSTED)) for k in start if k in sums}
        prose = Prose(near, pooled if len(is_prose) >= LEAST_LABELLED or not near else _pool(sums, near, share))
    if len(is_prose) >= LEAST_LABELLED and 0 < is_prose.sum() < len(is_prose):
        prose.cutoff = best_cutoff(prose.distances(langs, x)[0], is_prose)
    else:
        sums = _sums(stats, prose)
        all_ = sum(sums[k] for k in near) if near else sum(sums.values())
        prose.cutoff = SLACK * math.exp((_upto(all_, TRUSTED * QUANTILE) + 1) / _PER_UNIT + _LOW)
    return prose


def _pool(sums: dict[str, np.ndarray], langs: dict, share: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    return _of_sums(sum(sums[k][: _upto(sums[k], share.get(k, TRUSTED)) + 1].sum(0) for k in langs))


def judge_documents(df: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language, distance, cutoff, contributions (map statistic -> part of the squared distance), `unlike_prose`
    (beyond the cutoff), and one column per statistic: one row per document that has text."""
    stats = cut(document_statistics(df, key, text))
    prose = fit_prose(stats, labels, key)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, language string, stats array<double>, distance double, parts array<double>"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            if not len(langs):
                continue
            d, parts = prose.distances(langs, _matrix(batch, 2))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * _K, pa.int32()), pa.array(parts.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.sqrt(np.maximum(d, 0))), lists], names=[key, "language", "stats", "distance", "parts"])

    cutoff = math.sqrt(prose.cutoff) if prose else 0.0
    return stats.mapInArrow(go, schema).select(
        key,
        "language",
        "distance",
        F.lit(cutoff).alias("cutoff"),
        F.map_from_arrays(F.array(*map(F.lit, STATISTICS)), "parts").alias("contributions"),
        (F.col("distance") > cutoff).alias("unlike_prose"),
        *(F.col("stats")[i].alias(name) for i, name in enumerate(STATISTICS)),
    )
