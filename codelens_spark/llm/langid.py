"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded through per-width filter tables (a filter of width w is w rows of weights looked up by the byte and
summed), passed through ReLU and max-pooled over each fixed-length window; a softmax over the pooled features gives the
language of the window. A text is cut into windows that cover it whole; its prediction is the mean of the windows'
probabilities weighted by their lengths. Training uses only text and lang of a bounded sample of labelled rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import text_buffers

MOST_LANGUAGES = 1000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bytes are looked up by class: a-z (capitals alike), blanks and digits, other ASCII, and each byte above 127.
CLASSES = 96
SAMPLE_TEXTS, TEXT_WINDOWS = 600, 4  # per language: the bound of the training sample
EPOCHS, BATCH, RATE = 12, 128, 0.01
HELD_OUT_MOD = 5
UNKNOWN = "und"
LEAST_SCORE = 0.3  # a little over chance among four languages


def _classes() -> np.ndarray:
    of = np.zeros(256, np.uint8)
    for i in range(26):
        of[ord("a") + i] = of[ord("A") + i] = 1 + i
    of[[ord("'"), ord("-")]] = 27
    of[128:] = 28 + (np.arange(128) % 64)  # continuation and lead bytes share cells; windows hold both
    of[192:] = 28 + 64 + (np.arange(64) >> 4)
    return of


CLASS_OF = _classes()


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, CLASSES, FILTERS)
    bias: np.ndarray  # (all filters,)
    weights: np.ndarray  # (all filters, languages)
    offset: np.ndarray  # (languages,)

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled features of windows (rows of byte classes) and where each maximum lies."""
        out, places = [], []
        for w in self.filters:
            span = codes.shape[1] - len(w) + 1
            total = w[0][codes[:, :span]]
            for j in range(1, len(w)):
                total += w[j][codes[:, j: j + span]]
            at = total.argmax(axis=1)
            places.append(at)
            out.append(np.take_along_axis(total, at[:, None], axis=1)[:, 0])
        return np.concatenate(out, axis=1), places

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        x = np.maximum(pooled + self.bias, 0) @ self.weights + self.offset
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of WINDOW byte classes, class 0 behind the end), the text of each and its length. They cover all
    of every text; the last window of a text is short."""
    length = np.diff(at)
    count = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][text] + first * WINDOW
    size = np.minimum(WINDOW, at[1:][text] - start)
    place = np.minimum(start[:, None] + np.arange(WINDOW), max(len(data) - 1, 0))
    codes = CLASS_OF[data[place]] if len(text) else np.zeros((0, WINDOW), np.uint8)
    codes[np.arange(WINDOW) >= size[:, None]] = 0
    return codes, text, size


def train(codes: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross-entropy of window labels; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.filters, net.bias, net.weights, net.offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // BATCH)):
            x, y = codes[at], labels[at]
            pooled, places = net.pooled(x)
            hidden = np.maximum(pooled + net.bias, 0)
            error = net.probabilities(pooled)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ net.weights.T) * (hidden > 0)
            grads = []
            for k, w in enumerate(net.filters):
                g = np.zeros_like(w)
                own = back[:, k * FILTERS: (k + 1) * FILTERS]
                for j in range(len(w)):
                    np.add.at(g[j], (np.take_along_axis(x, places[k] + j, axis=1), np.arange(FILTERS)[None]), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """The trained network with its filters merged into tables over pairs of byte classes, for fast scoring."""

    def __init__(self, net: Network):
        self.net = net
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        self.two, self.three, self.four = net.filters[0], net.filters[1], net.filters[2]
        self.table2 = pair(self.two[0], self.two[1])
        self.table3 = pair(self.three[0], self.three[1])
        self.table4a, self.table4b = pair(self.four[0], self.four[1]), pair(self.four[2], self.four[3])

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Language probabilities of windows, some at a time so that the tables' rows stay in the processor's cache."""
        return np.concatenate([self._some(codes[i: i + 64]) for i in range(0, len(codes), 64)])

    def _some(self, codes: np.ndarray) -> np.ndarray:
        look = lambda rows, at: rows.take(at, axis=0, mode="clip")
        codes = np.ascontiguousarray(codes.T).astype(np.int64)  # positions first: the maximum runs over whole rows
        pairs = codes[:-1] * CLASSES + codes[1:]
        two = look(self.table2, pairs).max(axis=0)
        total = look(self.table3, pairs[:-1])
        total += look(self.three[2], codes[2:])
        three = total.max(axis=0)
        total = look(self.table4a, pairs[:-2])
        total += look(self.table4b, pairs[2:])
        return self.net.probabilities(np.concatenate((two, three, total.max(axis=0)), axis=1))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == 0


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to TEXT_WINDOWS windows of every text, drawn from all over it by a hash of the text."""
    for batch in batches:
        data, at = text_buffers(batch.column(0))
        langs, out_codes, out_langs = batch.column(1).to_pylist(), [], []
        for i in range(batch.num_rows):
            codes, _, size = windows_of(data, at[i: i + 2])
            full = np.flatnonzero(size >= min(WINDOW // 4, size.max(initial=1)))
            rng = np.random.default_rng(zlib.crc32(data[at[i]: at[i + 1]].tobytes()))
            for k in rng.permutation(full)[:TEXT_WINDOWS]:
                out_codes.append(codes[k].tobytes())
                out_langs.append(langs[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_codes, pa.binary()), pa.array(out_langs, pa.string())], names=["codes", "lang"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, languages_at_most: int = MOST_LANGUAGES) -> Network | None:
    """Train on a sample: of every language about `texts` labelled rows that are not held out, chosen by a hash of
    their id. None if no row has a label. More than `languages_at_most` languages raise, for the network has a row of
    weights for each and its sample grows with them; raise the bound to learn more. Only the sample's windows (at most 4 of 256 bytes a text) reach the driver."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id")))
    counts = {r["lang"]: r["count"] for r in usable.select("lang").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages_at_most + 1).collect()}
    if len(counts) > languages_at_most:
        raise ValueError(f"more than {languages_at_most} languages: pass a larger languages_at_most")
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, texts / n))])
    drawn = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.filter(drawn < F.element_at(share, F.col("lang"))).select("text", "lang")
    got = sample.mapInArrow(_training_rows, "codes binary, lang string").orderBy("lang", F.xxhash64("codes"), "codes")
    got = got.limit(2 * texts * TEXT_WINDOWS * len(counts)).toPandas()
    if not len(got):
        return None
    languages = sorted(set(got["lang"]))
    codes = np.frombuffer(b"".join(got["codes"]), np.uint8).reshape(-1, WINDOW)
    labels = np.searchsorted(np.array(languages, object), got["lang"].to_numpy(object))
    return train(codes, labels.astype(np.int64), languages)


@functools.lru_cache(maxsize=2)
def _scorer(key: bytes) -> Scorer:
    import pickle

    return Scorer(pickle.loads(key))


def _predict(net: Network | None):
    import pickle

    packed = pickle.dumps(net)
    letters = r"\pL"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        score = _scorer(packed) if net else None
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            lettered = np.array(pc.match_substring_regex(batch.column(1).fill_null(""), letters))
            total = np.zeros((batch.num_rows, len(net.languages) if net else 1))
            if net:
                i = 0
                while i < batch.num_rows:  # some hundred windows at a time; a long text on its own, in slices
                    j = max(i + 1, int(np.searchsorted(at, at[i] + 512 * WINDOW, "right")) - 1)
                    for lo in range(int(at[i]), max(int(at[j]), int(at[i]) + 1), 1024 * WINDOW):
                        hi = min(int(at[j]), lo + 1024 * WINDOW) if j == i + 1 else int(at[j])
                        cut = np.clip(at[i: j + 1], lo, hi)
                        codes, text, size = windows_of(data, cut)
                        if len(text):
                            p = score(codes) * size[:, None]
                            np.add.at(total, text + i, p)
                        if j > i + 1:
                            break
                    i = j
            length = np.maximum(np.diff(at), 1)[:, None]
            best = total.argmax(axis=1)
            known = lettered & (total.max(axis=1) > 0)
            value = np.clip((total / length).max(axis=1), 0, 1)
            names = np.array(net.languages if net else [UNKNOWN], object)[best]
            names[~known] = UNKNOWN
            value[~known] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(value)], names=["id", "held", "lang", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None) -> DataFrame:
    """Per row: (id, held_out boolean, lang_pred string, score double).

    lang_pred is the likeliest learned language over all windows of the text, score its mean probability. A text that is
    null or has no letter, or any text if nothing could be learned, is `und` with score 0. A row is held out of
    training if crc32 of its id as text is divisible by 5; a null id counts as not held out. Repeated rows are kept,
    other columns are not read, an empty table gives an empty table. Pass `net` to use a trained network.
    """
    net = net or fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, held boolean, lang string, score double"
    return rows.mapInArrow(_predict(net), schema).toDF(id_col, "held_out", "lang_pred", "score")


def accepted() -> Column:
    """What the pipeline keeps of `identify`: texts with letters whose best language has a mean probability of at least LEAST_SCORE."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
