"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier of all words on its posterior labels.

Sixteen voters (lexicons of insults, threats and profanity in four languages, and patterns such as insults beside "you", shouting, masked words)
look at each whole text. The label model knows only which of them vote together: counts of the vote patterns (2**16 at most, whatever the
corpus) go to the driver, where expectation-maximisation estimates the class share, each voter's rates in
both classes (its accuracy) and the voters' covariance within a class (their correlations, which keeps voters that repeat each other from counting twice); labelled training rows
hold their own class in it. A logistic regression on term counts, patterns and the hashed words and word beginnings of the whole text is then fitted to all
training rows, labelled ones by their label and others by their posterior, so that words outside the lexicon count in any language. Gradients are summed by partition; L-BFGS
steps need a few vectors of a fixed size on the driver. One model is fitted without each inner fold of the training rows; a labelled row is calibrated
by the score of the model that has not seen it, and every text is scored by the mean of the models.

Defined cases: null and empty texts get no votes and are scored like any text without them; a document labelled twice counts once; a row without
doc_id is scored and held out of training; rows that repeat a doc_id are scored each; without labels the posteriors alone
decide. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytescan import raw_bytes, xxh64
from .common import cut, slices, with_fields
from .fitting import Isotonic, fold, labels_of, partition_sum

# Words that insult, threaten or swear, by language and kind; plain forms, A-Z as a-z.
LEXICON = {
    "insult_person": "idiot idiots moron morons loser losers clown clowns scum trash garbage fool fools imbecile imbeciles cretin dimwit halfwit jerk jerks creep creeps pig pigs vermin coward cowards bastard bastards douchebag scumbag lowlife parasite".split(),
    "insult_quality": "stupid pathetic worthless disgusting dumb brainless useless hopeless ridiculous repulsive revolting filthy despicable contemptible vile ugly idiotic moronic".split(),
    "threat": "kill murder strangle slaughter exterminate lynch behead hang".split(),
    "profanity": "fuck fucking fucked fucker shit shitty bullshit bitch asshole crap damn dickhead whore slut cunt".split(),
    "french": "imbécile crétin abruti abrutie connard connasse salaud salope merde enculé débile ordure minable pourriture bouffon".split(),
    "german": "vollidiot dummkopf arschloch scheiße scheisse trottel depp blödmann wichser abschaum versager miststück schlampe hurensohn".split(),
    "spanish": "idiota imbécil estúpido estúpida tonto gilipollas cabrón mierda puta pendejo basura asqueroso asquerosa patético payaso".split(),
}
# Words of address.
ADDRESS = "you your youre u ur tu toi vous votre du dich ihr dein deine tú usted ustedes vosotros eres".split()

VOTERS = (*LEXICON, "two_hits", "two_terms", "dense_hits", "at_someone", "shouted_hit", "masked_word", "bang_burst", "stretched", "mostly_capitals")
TERMS = tuple(dict.fromkeys(w for group in LEXICON.values() for w in group))
_KIND = [[k for k, group in enumerate(LEXICON.values()) if w in group] for w in TERMS]
_ADDRESS = tuple(w for w in ADDRESS if w not in TERMS)
#: Dense inputs of the linear classifier: a weight for each voter and term, density and intercept.
SIZE = len(VOTERS) + len(TERMS) + 2
#: Hashed inputs: every word, and the beginnings (so many bytes) of longer ones.
BUCKETS = 1 << 14
BEGINNINGS = (4, 6, 8)
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
RIDGE, BUCKET_RIDGE = 1.0, 20.0
#: Weight of a row that only its posterior labels.
UNLABELLED = 0.3
INNER = 4
EM_ROUNDS, STEPS = 25, 20
#: Bytes of text, and rows, that one step looks at: the buckets of a text take some ten times its size.
SLICE, _ROWS = 1 << 20, 512

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOG = np.log1p(np.arange(256))
_ESCAPE = 255


def _key(lanes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """First and last bytes and the length of a word as one number; candidates are compared in full after it."""
    n = end - start
    head = lanes[start] & np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(n, 7)).astype(np.uint64)) - np.uint64(1))
    with np.errstate(over="ignore"):
        return head * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)


def _lanes(buf: np.ndarray) -> np.ndarray:
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def _dictionary() -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    words = [w.encode() for w in (*TERMS, *_ADDRESS)]
    joined = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    keys = _key(_lanes(joined), end - [len(w) for w in words], end)
    order = np.argsort(keys, kind="stable")
    return keys[order], order, words


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, which are letters, where texts begin, and the start, end and text of each run of letters."""
    low = _FOLD[raw]
    letter = _LETTER[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[offsets] = True
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    edge |= fresh
    start = np.flatnonzero(letter & edge[:-1])
    end = np.flatnonzero(letter & edge[1:]) + 1
    return low, letter, fresh, start, end, np.searchsorted(offsets, start, side="right") - 1


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashed words and beginnings of n texts as (text, bucket, count), and the number of words of each text."""
    raw, offsets = raw_bytes(texts)
    n, none = len(offsets) - 1, np.zeros(0, np.int64)
    if not len(raw):
        return none, none, none, np.zeros(n, np.int64)
    low, _, _, start, end, doc = _words(raw, offsets)
    codes = []
    for size in (None, *BEGINNINGS):
        long = slice(None) if size is None else end - start > size
        stop = end if size is None else start[long] + size
        codes.append(doc[long] * BUCKETS + (xxh64(low, start[long], stop) % np.uint64(BUCKETS)).astype(np.int64))
    code, count = np.unique(np.concatenate(codes), return_counts=True)
    return code // BUCKETS, code % BUCKETS, count, np.bincount(doc, minlength=n)


def signals(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For n texts: votes (n x voters, bool), density of hits, and hits as (text, term, count)."""
    raw, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    votes, none = np.zeros((n, len(VOTERS)), bool), np.zeros(0, np.int64)
    if not len(raw):
        return votes, np.zeros(n), none, none, none
    low, letter, fresh, start, end, doc = _words(raw, offsets)
    keys, order, words = _dictionary()
    own = _key(_lanes(low), start, end)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    found = np.flatnonzero(keys[at] == own)
    body = low.tobytes()
    entry = [-1] * len(found)
    table = {w: i for i, w in enumerate(words)}
    for k, i in enumerate(found.tolist()):
        entry[k] = table.get(body[start[i] : end[i]], -1)
    entry = np.array(entry, np.int64)
    ok = entry >= 0
    found, entry = found[ok], entry[ok]
    hit = entry < len(TERMS)
    word, term = found[hit], entry[hit]
    home = doc[word]
    hits = np.bincount(home, minlength=n)
    code, count = np.unique(home * len(TERMS) + term, return_counts=True)
    d, t = code // len(TERMS), code % len(TERMS)
    for k in range(len(LEXICON)):
        votes[d[np.isin(t, [i for i, kinds in enumerate(_KIND) if k in kinds])], k] = True
    vote = lambda name: votes[:, VOTERS.index(name)]
    size = np.diff(offsets)
    n_words = np.bincount(doc, minlength=n)
    density = hits / np.maximum(n_words, 1)
    vote("two_hits")[:] = hits >= 2
    vote("two_terms")[:] = np.bincount(d, minlength=n) >= 2
    vote("dense_hits")[:] = (density >= 0.005) & (hits > 0)
    address = np.zeros(len(start) + 6, bool)
    address[found[~hit] + 3] = True
    beside = np.zeros(len(word), bool)
    for k in range(7):  # within three words, in the same text
        there = np.clip(word + k - 3, 0, len(start) - 1)
        beside |= address[word + k] & (doc[there] == home)
    vote("at_someone")[home[beside]] = True
    vote("shouted_hit")[home[_UPPER[raw[start[word]]] & _UPPER[raw[end[word] - 1]]]] = True

    def runs(mark: np.ndarray, least: int) -> np.ndarray:
        """Texts with a run of at least so many marked bytes."""
        side = np.ones(len(raw) + 1, bool)
        side[1:-1] = mark[1:] != mark[:-1]
        side |= fresh
        a, b = np.flatnonzero(mark & side[:-1]), np.flatnonzero(mark & side[1:]) + 1
        return np.searchsorted(offsets, a[b - a >= least], side="right") - 1

    star = raw == 0x2A
    masked = np.zeros(len(raw), bool)
    masked[1:-1] = star[1:-1] & letter[:-2]  # a letter, stars, a letter
    run_a = np.flatnonzero(masked)
    if len(run_a):
        stop = np.append(np.flatnonzero(~star), len(raw) - 1)
        after = stop[np.searchsorted(stop, run_a)]
        inside = (after - run_a >= 2) & letter[after] & (np.searchsorted(offsets, run_a, side="right") == np.searchsorted(offsets, after, side="right"))
        vote("masked_word")[np.searchsorted(offsets, run_a[inside], side="right") - 1] = True
    vote("bang_burst")[runs(raw == 0x21, 3)] = True
    same = np.zeros(len(raw), bool)
    same[1:] = letter[1:] & (low[1:] == low[:-1])
    vote("stretched")[runs(same, 3)] = True
    upper = np.add.reduceat(np.append(_UPPER[raw], False), np.minimum(offsets[:-1], len(raw)), dtype=np.int64) * (size > 0)
    letters = np.add.reduceat(np.append(letter, False), np.minimum(offsets[:-1], len(raw)), dtype=np.int64) * (size > 0)
    vote("mostly_capitals")[:] = (upper > 0.5 * letters) & (letters >= 20)
    return votes, density, d, t, count


def signal_table(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id[, carry], mask (the votes as bits), density, terms and counts of the hits; buckets (16 bits each), their counts (8 bits; 255 stands for the next of large, the counts from 255 on) and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            votes, density, d, t, c = signals(part.column("text"))
            cuts = pa.array(np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (t, c)]
            mask = (votes * (1 << np.arange(len(VOTERS)))).sum(1).astype(np.int32)
            home, bucket, times, words = buckets(part.column("text"))
            at = np.searchsorted(home, np.arange(part.num_rows + 1)).tolist()
            packed = [[x[a:b].tobytes() for a, b in zip(at, at[1:])] for x in (bucket.astype("<u2"), np.minimum(times, _ESCAPE).astype(np.uint8))]
            packed.append([(x := times[a:b])[x >= _ESCAPE].astype("<u4").tobytes() for a, b in zip(at, at[1:])])
            columns = [part.column("doc_id"), pa.array(mask), pa.array(density), *lists, *(pa.array(x, pa.binary()) for x in packed), pa.array(words), *(part.column(c) for c in carry)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mask", "density", "terms", "counts", "buckets", "times", "large", "words", *carry])

    columns = "doc_id long, mask int, density double, terms array<int>, counts array<int>, buckets binary, times binary, large binary, words long"
    read = docs.select(F.col("doc_id").cast("long"), "text", *carry)
    return read.mapInArrow(run, with_fields(columns, read, carry))


def bits(mask: np.ndarray) -> np.ndarray:
    return (mask[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


class LabelModel:
    """P(toxic | votes): two classes with rates of their own and one covariance within the classes."""

    def fit(self, mask: np.ndarray, free: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> LabelModel:
        """Patterns, and how many rows have each: unlabelled, labelled 1 and labelled 0."""
        v = bits(mask)
        known = ones.sum() + zeros.sum()
        start = v[:, : len(LEXICON)].any(1)
        q = np.where(start, 0.9, 0.02)
        # 20 rows' worth of a lexicon voter's usual rates keep the classes from changing places
        prior = np.array([[0.02] * len(VOTERS), [0.3] * len(LEXICON) + [0.3] * (len(VOTERS) - len(LEXICON))])
        for _ in range(EM_ROUNDS):
            w = np.array([free * (1 - q) + zeros, free * q + ones])
            total = w.sum(1)
            self.rates = (w @ v + 20 * prior) / (total[:, None] + 20)
            self.share = ones.sum() / known if known else (total[1] + 1) / (total.sum() + 2)
            cov = sum((w[c][:, None] * (v - self.rates[c])).T @ (v - self.rates[c]) for c in (0, 1)) / max(total.sum(), 1)
            cov = 0.9 * cov + np.diag(0.1 * np.diag(cov) + 2e-3)
            self.weights = np.linalg.solve(cov, self.rates[1] - self.rates[0])
            self.base = np.log(self.share + 1e-6) - np.log(1 - self.share + 1e-6) - 0.5 * (self.rates[1] + self.rates[0]) @ self.weights
            q = self.posterior(mask)
        return self

    def posterior(self, mask: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(bits(mask) @ self.weights + self.base, -12, 12)))


def _design(batch: pa.RecordBatch) -> np.ndarray:
    n = batch.num_rows
    x = np.zeros((n, SIZE))
    x[:, : len(VOTERS)] = bits(batch.column("mask").to_numpy())
    terms, counts = batch.column("terms"), batch.column("counts")
    row = np.repeat(np.arange(n), np.diff(terms.offsets.to_numpy()))
    x[row, len(VOTERS) + terms.flatten().to_numpy()] = np.log1p(counts.flatten().to_numpy())
    x[:, -2] = np.minimum(100 * batch.column("density").to_numpy(), 5)
    x[:, -1] = 1
    return x


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value: log of the count, by the root of the number of words."""
    packed = batch.column("buckets").to_pylist()
    row = np.repeat(np.arange(batch.num_rows), [len(x) // 2 for x in packed])
    times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint8)
    logs = _LOG[times]
    logs[times == _ESCAPE] = np.log1p(np.frombuffer(b"".join(batch.column("large").to_pylist()), "<u4"))
    words = np.maximum(batch.column("words").to_numpy(), 1)
    return row, np.frombuffer(b"".join(packed), "<u2").astype(np.int64), 10 * logs / np.sqrt(words)[row]


def raw_scores(batch: pa.RecordBatch, theta: np.ndarray) -> np.ndarray:
    """A row of raw scores for each model (a row of theta)."""
    row, bucket, value = _hashed(batch)
    return _design(batch) @ theta[:, :SIZE].T + np.column_stack([np.bincount(row, value * t[SIZE:][bucket], batch.num_rows) for t in theta])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(a, _ROWS) for a in range(0, batch.num_rows, _ROWS))


def _descent(size: int, steps: int, memory: int = 8) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS: yields a point, is sent its value and slope, returns the last point."""
    x = np.zeros(size)
    value, slope = yield x
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append(way @ s / (y @ s))
            way -= shares[-1] * y
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(np.linalg.norm(slope), 1e-12)
        for (s, y), share in zip(moves, reversed(shares)):
            way += s * (share - y @ way / (y @ s))
        far = 1.0
        while True:
            there = x - far * way
            value2, slope2 = yield there
            if value2 <= value - 1e-4 * far * (slope @ way):
                break
            far /= 2
            if far < 1e-3:
                return x
        if (there - x) @ (slope2 - slope) > 1e-12:
            moves = [*moves, (there - x, slope2 - slope)][-memory:]
        x, value, slope = there, value2, slope2
        if np.linalg.norm(slope) < 1e-3:
            break
    return x


def fit_linear(train: DataFrame, model: LabelModel, ridge: float = RIDGE, bucket_ridge: float = BUCKET_RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of INNER logistic regressions, each without one inner fold, on the labels and, for rows without one, the posteriors; all take a step in one pass."""
    size = SIZE + BUCKETS
    penalty = np.concatenate([np.full(SIZE - 1, ridge), [1e-6], np.full(BUCKETS, bucket_ridge)])
    runs = [_descent(size, steps) for _ in range(INNER)]
    theta = np.array([next(run) for run in runs])
    open_ = list(range(INNER))
    while open_:
        now = theta[open_]

        def part(batch: pa.RecordBatch, now: np.ndarray = now, open_: tuple[int, ...] = tuple(open_)) -> np.ndarray:
            total = np.zeros((len(open_), 1 + size))
            for piece in _pieces(batch):
                label = piece.column("label").to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(label)
                y = np.where(known, label, model.posterior(piece.column("mask").to_numpy()))
                inner = piece.column("inner").to_numpy()
                x, (row, bucket, value) = _design(piece), _hashed(piece)
                for k, g in enumerate(open_):
                    z = np.clip(x @ now[k, :SIZE] + np.bincount(row, value * now[k, SIZE:][bucket], piece.num_rows), -30, 30)
                    n = np.where(known, 1.0, UNLABELLED) * (inner != g)
                    error = n * (_logistic(z) - y)
                    total[k, 0] += n @ (np.logaddexp(0, z) - y * z)
                    total[k, 1 : 1 + SIZE] += x.T @ error
                    total[k, 1 + SIZE :] += np.bincount(bucket, value * error[row], BUCKETS)
            return total.ravel()

        sums = partition_sum(train, len(open_) * (1 + size), part).reshape(len(open_), 1 + size)
        for k, g in enumerate(list(open_)):
            try:
                theta[g] = runs[g].send((sums[k, 0] + 0.5 * penalty @ now[k] ** 2, sums[k, 1:] + penalty * now[k]))
            except StopIteration as end:
                theta[g] = end.value
                open_.remove(g)
    return theta


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted[, carried columns] for each document; rows whose fold is held are never trained on."""
    # one table serves training and scoring, so that the buckets are shuffled and stored once; the same plan at all sizes
    table = cut(signal_table(docs, carry).join(labels_of(labels, "toxic").hint("merge"), "doc_id", "left"))
    inner = fold(F.concat(F.lit("inner "), F.col("doc_id").cast("string")), INNER).alias("inner")
    train = table.filter(fold(F.col("doc_id"), folds) != held).select("*", inner)
    train = train.coalesce(max(1, -(-train.count() // 10_000)))
    grouped = train.groupBy("mask").agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("ones"), F.count("label").alias("known"))
    patterns = grouped.orderBy("mask").collect()  # 2**16 rows at most
    mask = np.array([r["mask"] for r in patterns], np.int64)
    ones = np.array([r["ones"] or 0.0 for r in patterns], float)
    known = np.array([r["known"] or 0.0 for r in patterns], float)
    model = LabelModel().fit(mask, np.array([r["n"] for r in patterns], float) - known, ones, known - ones)
    theta = fit_linear(train, model)
    iso = Isotonic(-15.0, 15.0)

    def labelled(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(3 * iso.BINS)
        for piece in _pieces(batch):
            own = raw_scores(piece, theta)[np.arange(piece.num_rows), piece.column("inner").to_numpy()]
            total += iso.sums(np.clip(own, -15, 15), piece.column("label").to_numpy())
        return total

    sums = partition_sum(train.filter("label is not null"), 3 * iso.BINS, labelled)
    calibrated = sums[: iso.BINS].sum() > 0
    if calibrated:
        iso.fit(sums)
    mean = theta.mean(0, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                raw = np.clip(raw_scores(piece, mean)[:, 0], -15, 15)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(iso.apply(raw) if calibrated else _logistic(raw)), *(piece.column(c) for c in carry)], ["doc_id", "score", *carry])

    scored = table.mapInArrow(run, with_fields("doc_id long, score double", table, carry))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
