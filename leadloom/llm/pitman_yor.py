"""Language-model scores under a hierarchical Pitman-Yor model, and smoothed unigram scores beside them.

The next word is drawn in the restaurant of the word before it (the end of the text before, for a first word): every
word of the training texts is a context of its own. All these restaurants share one parent over words, and its base
spells words byte by byte: a restaurant for each byte before, sharing a parent over bytes above the uniform
distribution. Words that no training text has are one event together, as in the unigram scores: the probability that
remains beside all known words.

What is sampled is how many tables each dish has, by Gibbs steps: a step draws the number of a dish from its whole
conditional distribution given all other dishes, with the customers that its tables send to the parent. A dish with one
customer has one table, so that only pairs of words that training texts have twice or more are sampled; all others
count in full in their restaurants, in the parent and in the scores. A sweep takes the dishes in COLOURS random classes,
the restaurants' totals following from class to class. Sweeps run over buckets of words side by side; between two sweeps
buckets exchange the tables of their contexts, and sums. Once these settle, a word's probability is the mean of its
predictive probabilities over SAMPLES states, a sweep apart.

Documents are bundled into segments of bounded size. A segment's distinct pairs, not its tokens, are what is shuffled:
to buckets by the word's 64-bit hash for counting and seating, and back with what its scores need.

Null texts count as empty: the end alone. Repeated documents count and are scored one by one; null doc_ids are in fold 0.
Without training documents all tokens are that one event, of probability 1; without documents there are no scores. A text
of any length lies in one segment. Other columns are ignored.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import discard, remainder, text_or_empty, written

FOLDS, SMOOTHING = 10, 0.1
#: States that are averaged; random classes of dishes in a sweep; sweeps between which table totals are compared, the share and
#: square roots by which they may change then; sweeps after which it is an error if they have not settled.
SAMPLES, COLOURS, LAG, SETTLED, NOISE, MOST_SWEEPS = 3, 2, 1, 0.001, 3, 1000
STRENGTH = 1.0
SEED = 10
#: Tokens after which a segment is closed; pairs of all segments that a bucket takes.
SEGMENT_TOKENS, BUCKET_PAIRS = 2_000_000, 1_500_000
#: Customers up to which Stirling numbers are summed up by their recursion; beyond, the same numbers are had from an integral over CONTOUR
#: points, or its saddle point where that lies FAR out (the tests hold the draws of both against each other). Places at which a dish of more is looked at.
EXACT, CONTOUR, FAR, GRID = 1024, 12, 20.0, 48

#: A to Z become lower case; all white space becomes a blank.
LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)
LOWER_BYTES = LOWER.tobytes()
#: The end of a text, as a word; no other word is empty.
END, END_HASH = b"", 0

SEGMENTS = "segment long, doc_ids array<long>, held_out array<boolean>, n_tokens array<long>, n_pairs long, tokens binary, hashes binary, spelling binary"


def log_gamma(z: np.ndarray) -> np.ndarray:
    """log of the gamma function for z > 0."""
    z = np.asarray(z, float)
    shift = np.log(z) + np.log((z + 1) * (z + 2) * (z + 3)) + np.log((z + 4) * (z + 5) * (z + 6) * (z + 7))
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat so many customers at so many tables."""
    log_s = np.full((n + 1, n + 1), -np.inf)
    log_s[0, 0] = 0
    for c in range(n):
        k = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = log_s[c, 1 : c + 2] + np.log(np.maximum(c - k * discount, 0))
        log_s[c + 1, 1 : c + 2] = np.logaddexp(log_s[c, : c + 1], stay)
    return log_s


class Stirling:
    """Generalised Stirling numbers of a discount, by recursion for few customers and from their generating function for many."""

    def __init__(self, discount: float):
        self.discount, self.exact = discount, log_stirling(discount)
        log_u = np.concatenate([np.linspace(-700, -5, 8000), np.log(np.linspace(np.exp(-5), 1 - 1e-3, 4000))[1:], np.log1p(-np.logspace(-3, -10, 400))[1:]])
        log_f = np.log(-np.expm1(discount * log_u))
        share = log_f - np.log(discount) - np.log(-np.expm1(log_u)) - (discount - 1) * log_u
        self.share, self.log_u = share, log_u

    def large(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Logarithms, less log(c!): from the generating function's c-th coefficient, by saddle point where that lies far from its singularity and along Talbot's contour elsewhere."""
        d = self.discount
        c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
        log_u = np.interp(np.log(np.minimum(t, c - 0.5) / c), self.share, self.log_u)
        x, log_f = -np.expm1(log_u), np.log(-np.expm1(d * log_u))
        r = d * x * np.exp((d - 1) * log_u - log_f)
        spread = r * np.maximum(1 + x * (1 - d) * np.exp(-log_u) - r, 1e-12)
        found = t * log_f - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * spread)
        place = -c * np.log(x)
        close = place < FAR
        if close.any():
            c_, t_, r = c[close], t[close], np.maximum(place[close], 0.4 * CONTOUR)
            log_f = lambda s: np.log(1 - (-np.expm1(-s / c_)) ** d)
            middle, total = log_f(r), np.full(len(r), 0.5)
            for theta in np.arange(1, CONTOUR) * np.pi / CONTOUR:
                cot = 1 / np.tan(theta)
                s = r * theta * (cot + 1j)
                total += (np.exp(t_ * (log_f(s) - middle) + s - r) * (1 + 1j * (theta + (theta * cot - 1) * cot))).real
            found[close] = t_ * middle + r + np.log(np.maximum(total, 1e-300) * r / CONTOUR / c_)
        return found - log_gamma(t + 1) - t * np.log(d)


def draw(customers: np.ndarray, tables: np.ndarray, others: np.ndarray, parent: tuple, numbers: Stirling, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with two customers or more, each from its conditional distribution.

    others: tables of the restaurant's other dishes. parent = (first, step, total): the chance that the parent
    serves the dish to a further table is (first + step * k) / (total + step * k), when it has served k beyond the first one.
    """
    d, out = numbers.discount, tables.copy()
    first, step, total = parent
    order = np.argsort(customers, kind="stable")
    sizes = customers[order]
    at, end = 0, int(np.searchsorted(sizes, EXACT, "right"))
    while at < end:
        c = int(sizes[at])
        stop = min(int(np.searchsorted(sizes, c, "right")), at + max(1, (1 << 21) // c))
        i = order[at:stop]
        k = np.arange(1, c)
        gain = np.log(STRENGTH + d * (others[i][:, None] + k)) + np.log(first[i][:, None] + step * (k - 1)) - np.log(total[i][:, None] + step * (k - 1))
        weight = np.hstack([np.zeros((len(i), 1)), np.cumsum(gain, 1)]) + numbers.exact[c, 1 : c + 1]
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        out[i] = 1 + (weight < rng.random(len(i))[:, None] * weight[:, -1:]).sum(1)
        at = stop
    for at in range(end, len(order), 1 << 14):
        i = order[at : at + (1 << 14)]
        c, a, p, all_p = customers[i].astype(float), STRENGTH / d + others[i], first[i], total[i]

        def log_weight(t):
            over = (lambda x: x[:, None]) if t.ndim > 1 else (lambda x: x)
            more = t - 1
            from_parent = log_gamma(over(p) + more) - log_gamma(over(all_p) + more) if step else more * np.log(over(p / all_p))
            return numbers.large(over(c), t) + more * np.log(d) + log_gamma(over(a) + t) + from_parent

        def narrowed(low, high, go_up):
            """The last whole number from low on at which go_up holds."""
            while (high - low > 0.5).any():
                middle = np.ceil((low + high) / 2)
                up = go_up(middle)
                low, high = np.where(up, middle, low), np.where(up, high, middle - 1)
            return low

        top = narrowed(np.ones(len(i)), c.copy(), lambda t: log_weight(t) >= log_weight(np.maximum(t - 1, 1)))
        peak = log_weight(top)
        far = narrowed(top.copy(), c.copy(), lambda t: log_weight(t) > peak - 20)
        near = -narrowed(-top, -np.ones(len(i)), lambda t: log_weight(-t) > peak - 20)
        stride = np.maximum(1, np.ceil((far - near + 1) / GRID))
        t = near[:, None] + stride[:, None] * np.arange(GRID + 1)
        weight = np.where(t <= far[:, None], log_weight(np.minimum(t, c[:, None])) - peak[:, None], -np.inf)
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        place = (weight < rng.random(len(i))[:, None] * weight[:, -1:]).sum(1)
        jitter = np.rint((rng.random(len(i)) - 0.5) * stride)
        out[i] = np.clip(t[np.arange(len(i)), place] + jitter, 1, c)
    return out


def settled(before: np.ndarray, after: np.ndarray) -> bool:
    """Whether table totals changed in LAG sweeps by no more than their share and noise."""
    return bool((np.abs(after - before) <= SETTLED * before + NOISE * np.sqrt(before)).all())


def discount_of(ones: float, twos: float) -> float:
    """The usual estimate from how many dishes have one and two customers."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def predictive(c, t, all_c, all_t, base, discount):
    """Probability of each dish in its restaurant; base: the parent's."""
    return (c - discount * t + (STRENGTH + discount * all_t) * base) / (STRENGTH + all_c)


class Level:
    """Restaurants (`of` gives each dish's) over a parent restaurant with all their dishes (`word`), as far as they lie here: customers and tables.

    singles: tables of dishes with one customer, by word, which are not listed. rest: tables of the listed dishes' restaurants
    besides the listed ones.
    """

    def __init__(self, of, word, customers, tables, rest, singles, word_tables, base):
        self.of, self.word, self.customers, self.tables, self.rest, self.singles, self.word_tables, self.base = of, word, customers, tables, rest, singles, word_tables, base

    def served(self) -> np.ndarray:
        """The parent's customers by word."""
        return self.singles + np.bincount(self.word, self.tables, len(self.base)).astype(np.int64)

    def sweep(self, all_c: float, all_t: float, discount: float, up_discount: float, rng: np.random.Generator) -> None:
        """A Gibbs step of each dish, then one of each dish of the parent, whose customers and tables are all_c and all_t."""
        numbers, colour = Stirling(discount), rng.integers(0, COLOURS, len(self.of))
        own = np.bincount(self.of, self.tables, len(self.rest)).astype(np.int64)
        for k in range(COLOURS):
            i = np.flatnonzero(colour == k)
            served, t = self.served(), self.tables[i]
            besides = served[self.word[i]] - t + 1  # its first table is always there
            first = besides - up_discount * np.minimum(self.word_tables[self.word[i]], besides) + (STRENGTH + up_discount * all_t) * self.base[self.word[i]]
            others = self.rest[self.of[i]] + own[self.of[i]] - t
            self.tables[i] = draw(self.customers[i], t, others, (first, 1, STRENGTH + np.maximum(all_c - t + 1, 1)), numbers, rng)
            own += np.bincount(self.of[i], self.tables[i] - t, len(own)).astype(np.int64)
        served = self.served()
        self.word_tables = np.clip(self.word_tables, np.minimum(served, 1), served)
        many = np.flatnonzero(served > 1)
        t = self.word_tables[many]
        self.word_tables[many] = draw(served[many], t, all_t - t, (np.maximum(self.base[many], 1e-300), 0, np.ones(len(many))), Stirling(up_discount), rng)


def spelling_model(counts: np.ndarray) -> np.ndarray:
    """log10 probability of a byte after a byte (blank: no byte), from counts of such pairs; samples are averaged."""
    rng = np.random.default_rng(SEED)
    c = counts.astype(np.int64)
    c[32, 32] = 0  # words are not empty
    before, byte = np.nonzero(c > 1)
    ones = (c == 1).astype(np.int64)
    d, total, left, history = discount_of((c == 1).sum(), (c == 2).sum()), np.zeros((256, 256)), None, []
    level = Level(before, byte, c[before, byte], np.ones(len(before), np.int64), ones.sum(1), ones.sum(0), (c.sum(0) > 0).astype(np.int64), np.full(256, 1 / 256))
    for _ in range(MOST_SWEEPS):
        up, t = level.served(), ones.copy()
        t[before, byte] = level.tables
        up_d = discount_of((up == 1).sum(), (up == 2).sum())
        history.append(np.array([up.sum(), level.word_tables.sum()]))
        if left is None and len(history) > LAG and settled(history[-1 - LAG], history[-1]):
            left = SAMPLES
        if left is not None:
            parent = predictive(up, level.word_tables, up.sum(), level.word_tables.sum(), 1 / 256, up_d)
            total += predictive(c, t, c.sum(1)[:, None], t.sum(1)[:, None], parent[None], d)
            left -= 1
            if not left:
                break
        level.sweep(up.sum(), level.word_tables.sum(), d, up_d, rng)
    else:
        raise RuntimeError(f"spelling tables have not settled in {MOST_SWEEPS} sweeps")
    total[32, 32] = 0
    total /= total.sum(1)[:, None]
    total[32, 32] = 1e-300
    return np.log10(total)


def byte_pairs(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """How often a byte follows a byte in training texts, and how many training words and texts there are. At most 65,536 rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_words, n_docs = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                x = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
                x = LOWER[x]
                x = x[1:][(x[1:] != 32) | (x[:-1] != 32)]  # one blank after each word
                if len(x):
                    x = x.astype(np.int64)
                    total += np.bincount(np.concatenate([[32 << 8 | x[0]], x[:-1] << 8 | x[1:]]), minlength=1 << 16)
                    n_words += int((x == 32).sum())
                n_docs += 1
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.concatenate([used, [-1, -2]])), pa.array(np.concatenate([total[used], [n_words, n_docs]]))], ["pair", "n"])

    found = {r.pair: r.n for r in docs.filter("not held_out").select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(1 << 16, np.int64)
    for pair, n in found.items():
        if pair >= 0:
            counts[pair] = n
    return counts.reshape(256, 256), found.get(-1, 0), found.get(-2, 0)


class Numbered(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Segment:
    """Documents bundled up to SEGMENT_TOKENS tokens."""

    def __init__(self):
        self.numbers, self.tokens, self.doc_ids, self.held, self.size = Numbered({END: 0}), [], [], [], 0

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        found = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        ids = ids[ids != 0]  # runs of blanks
        self.tokens.append(np.append(ids, np.int32(0)))
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.size += len(ids) + 1

    def row(self, name: int, spell: np.ndarray, end_share: float) -> dict:
        words = list(self.numbers)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) | np.uint64(1)
        hashes[0] = END_HASH
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        n = np.array([len(t) for t in self.tokens])
        tokens = rank[np.concatenate(self.tokens)]
        # spelling: a blank, the word's bytes, a blank
        buffer = np.frombuffer(b" " + b" ".join(words[i] for i in order if words[i]) + b" ", np.uint8).astype(np.int64)
        spelling = np.full(len(words), np.log10(end_share))
        if len(words) > 1:
            starts = np.flatnonzero(buffer[:-1] == 32)
            spelling[1:] = np.add.reduceat(spell[buffer[:-1], buffer[1:]], starts) + np.log10(1 - end_share)  # END has the smallest hash
        return {
            "segment": name, "doc_ids": self.doc_ids, "held_out": self.held, "n_tokens": n.tolist(), "n_pairs": len(np.unique(pair_codes(tokens, len(words)))),
            "tokens": tokens.astype("<u4").tobytes(), "hashes": hashes[order].tobytes(), "spelling": spelling.astype("<f4").tobytes(),
        }


def pair_codes(tokens: np.ndarray, n_words: int) -> np.ndarray:
    """Each token's word and the word before it as one number, in order of the word first. Word 0, the end, stands before a text's first word."""
    return tokens.astype(np.int64) * n_words + np.concatenate([[0], tokens[:-1]])


def segments(docs: DataFrame, spell: np.ndarray, end_share: float) -> DataFrame:
    """One row for each segment of docs (doc_id, held_out, text). Written."""
    model = docs.sparkSession.sparkContext.broadcast((spell, end_share))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_pairs", pa.int64()), *[(c, pa.binary()) for c in ("tokens", "hashes", "spelling")]])
        own, k, part = Segment(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                own.add(*doc)
                if own.size >= SEGMENT_TOKENS:
                    yield pa.RecordBatch.from_pylist([own.row(part << 32 | k, *model.value)], schema)
                    own, k = Segment(), k + 1
        if own.size:
            yield pa.RecordBatch.from_pylist([own.row(part << 32 | k, *model.value)], schema)

    return written(docs.select("doc_id", "held_out", "text").mapInArrow(bundle, SEGMENTS), "segments")


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets follow the order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def tight(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest takes, with that width in front."""
    width = 1 if (top := int(x.max(initial=0))) < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def loose(data: bytes) -> np.ndarray:
    """The numbers of tight()."""
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def binaries(*names: str) -> list[tuple]:
    return [(c, pa.binary()) for c in names]


def sql(schema: pa.Schema) -> str:
    """A schema of longs, doubles, binaries and lists of them as Spark reads it."""
    kinds = {"int64": "long", "binary": "binary", "double": "double", "list<item: double>": "array<double>", "list<item: int64>": "array<long>"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


PART = pa.schema([("bucket", pa.int64()), ("segment", pa.int64()), *binaries("hashes", "spelling", "per_word", "contexts", "context_at", "counts")])


def to_buckets(table: DataFrame, n: int) -> DataFrame:
    """The segments' words and pairs, a row for each segment and bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hashes, spelling, tokens = wide(r["hashes"]), np.frombuffer(r["spelling"], "<f4"), np.frombuffer(r["tokens"], "<u4")
                pairs, at = np.unique(pair_codes(tokens, len(hashes)), return_inverse=True)
                counts = np.bincount(at, np.repeat(~np.array(r["held_out"]), r["n_tokens"]), len(pairs)).astype(np.int64)
                of, before = np.divmod(pairs, len(hashes))
                ends = np.searchsorted(bucket_of(hashes, n), np.arange(n + 1))
                cuts, out = np.searchsorted(of, ends), []
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    w, p = slice(ends[b], ends[b + 1]), slice(cuts[b], cuts[b + 1])
                    contexts, context_at = np.unique(before[p], return_inverse=True)
                    row = (b, r["segment"], hashes[w].tobytes(), spelling[w].tobytes(), tight(np.bincount(of[p] - ends[b], minlength=ends[b + 1] - ends[b])), hashes[contexts].tobytes(), tight(context_at), tight(counts[p]))
                    out.append(dict(zip(PART.names, row)))
                yield pa.RecordBatch.from_pylist(out, PART)

    return table.select("segment", "held_out", "n_tokens", "tokens", "hashes", "spelling").mapInArrow(cut, sql(PART))


#: A bucket's seating. words: the bucket's words (hashes); spelled: their base probabilities; seen: training tokens; singles and
#: word_tables: see Level; pairs of each word, contexts and pairs' places in them; customers and tables of pairs; drawn: sums of sampled
#: tables; parents: sampled probabilities of words. sent: for each bucket that owns contexts of this one, their hashes and tables here.
STATE = pa.schema([("bucket", pa.int64()), *binaries("spelled", "seen", "singles", "word_tables", "per_word", "contexts", "context_at", "customers", "tables", "drawn", "parents"), ("totals", pa.list_(pa.float64())), ("tally", pa.list_(pa.int64()))])
#: What merged() gives: the state, the words that a bucket owns, the tables of single customers by context, and places: by segment,
#: its words and pairs in the bucket (0 and 1: unseen and single pairs, others: place + 2 of a sampled one).
MERGED = pa.schema([*STATE, ("segment", pa.int64()), *binaries("words", "one_contexts", "one_tables", "word_at", "pair_at")])


def merged(table: pa.Table) -> pa.Table:
    """A bucket's words and pairs over all segments, with one table for each dish to start with."""
    rows = table.to_pylist()
    words, first, place = np.unique(np.concatenate([wide(r["hashes"]) for r in rows]), return_index=True, return_inverse=True)
    spelled = (10.0 ** np.concatenate([np.frombuffer(r["spelling"], "<f4") for r in rows]).astype(float))[first]
    contexts, context_place = np.unique(np.concatenate([wide(r["contexts"]) for r in rows]), return_inverse=True)
    starts, context_starts = (np.cumsum([0] + [len(r[c]) // 8 for r in rows]) for c in ("hashes", "contexts"))
    code = np.concatenate([np.repeat(place[starts[i] : starts[i + 1]], loose(r["per_word"])) * len(contexts) + context_place[context_starts[i] + loose(r["context_at"])] for i, r in enumerate(rows)])
    cuts = np.cumsum([0] + [len(loose(r["counts"])) for r in rows])
    pairs, at = np.unique(code, return_inverse=True)
    customers = np.bincount(at, np.concatenate([loose(r["counts"]) for r in rows]), len(pairs)).astype(np.int64)
    word, context = np.divmod(pairs, len(contexts))
    seen, one, many = np.bincount(word, customers, len(words)).astype(np.int64), customers == 1, customers > 1
    mark = one.astype(np.int64)
    mark[many] = np.arange(many.sum()) + 2
    used, context_at = np.unique(context[many], return_inverse=True)
    ones = np.bincount(context[one], minlength=len(contexts))
    state = state_row(rows[0]["bucket"], spelled, seen, np.bincount(word[one], minlength=len(words)), (seen > 0).astype(np.int64), word[many], contexts[used], context_at, customers[many], np.ones(many.sum(), np.int64), np.zeros(many.sum(), np.int64), b"")
    out = [{**state, "words": words.tobytes(), "one_contexts": contexts[ones > 0].tobytes(), "one_tables": tight(ones[ones > 0])}]
    out += [{"bucket": r["bucket"], "segment": r["segment"], "word_at": tight(place[starts[i] : starts[i + 1]]), "pair_at": tight(mark[at[cuts[i] : cuts[i + 1]]])} for i, r in enumerate(rows)]
    return pa.Table.from_pylist(out, MERGED)


def state_row(bucket, spelled, seen, singles, word_tables, word, contexts, context_at, customers, tables, drawn, parents) -> dict:
    """A bucket's seating, with what it adds to the totals: the parent's customers and tables, training tokens, words, their base probability; and tallies for discounts."""
    up = singles + np.bincount(word, tables, len(spelled)).astype(np.int64)
    totals = [up.sum(), word_tables.sum(), seen.sum(), (seen > 0).sum(), spelled[seen > 0].sum()]
    tally = [int(x) for x in (singles.sum(), (customers == 2).sum(), (up == 1).sum(), (up == 2).sum())]
    raw = {"seen": seen, "singles": singles, "word_tables": word_tables, "per_word": np.bincount(word, minlength=len(spelled)), "context_at": context_at, "customers": customers, "tables": tables, "drawn": drawn}
    return {"bucket": bucket, "spelled": spelled.astype("<f4").tobytes(), "contexts": contexts.tobytes(), "parents": parents, **{k: tight(v) for k, v in raw.items()}, "totals": [float(x) for x in totals], "tally": tally}


class Seating:
    """A bucket's state as arrays. elsewhere: its contexts' tables that are not of its own pairs."""

    def __init__(self, row: dict, totals: np.ndarray, tally: np.ndarray):
        self.bucket, self.contexts, self.parents = row["bucket"], wide(row["contexts"]), row["parents"]
        self.spelled = np.frombuffer(row["spelled"], "<f4").astype(float)
        self.seen, self.singles, word_tables, self.context_at, self.customers, tables, self.drawn = (loose(row[c]) for c in ("seen", "singles", "word_tables", "context_at", "customers", "tables", "drawn"))
        self.word = np.repeat(np.arange(len(self.spelled)), loose(row["per_word"]))
        base = np.where(self.seen > 0, self.spelled, max(0.0, 1 - totals[4]))
        self.all_c, self.all_t = totals[:2]
        self.discount, self.up_discount = discount_of(*tally[:2]), discount_of(*tally[2:])
        self.level = Level(self.context_at, self.word, self.customers, tables, np.zeros(len(self.contexts), np.int64), self.singles, word_tables, base)

    def own_tables(self) -> np.ndarray:
        """Tables of this bucket's listed pairs by context."""
        return np.bincount(self.context_at, self.level.tables, len(self.contexts)).astype(np.int64)

    def parent(self) -> np.ndarray:
        """The parent's probabilities of words."""
        return predictive(self.level.served(), self.level.word_tables, self.all_c, self.all_t, self.level.base, self.up_discount)

    def record(self) -> None:
        """Keep a sample."""
        self.drawn = self.drawn + self.level.tables
        self.parents += self.parent().astype("<f4").tobytes()

    def row(self) -> dict:
        lv = self.level
        return state_row(self.bucket, self.spelled, self.seen, self.singles, lv.word_tables, self.word, self.contexts, self.context_at, self.customers, lv.tables, self.drawn, self.parents)


SENT = pa.schema([("owner", pa.int64()), ("bucket", pa.int64()), *binaries("contexts", "tables")])


def sent(table: DataFrame, n: int, columns: tuple[str, ...], tables_of: Callable) -> DataFrame:
    """Buckets' tables by context, for the buckets that own these as words: a row for each pair of buckets that share any."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                contexts, tables = tables_of(r)
                ends = np.searchsorted(bucket_of(contexts, n), np.arange(n + 1))
                out = [{"owner": b, "bucket": r["bucket"], "contexts": contexts[ends[b] : ends[b + 1]].tobytes(), "tables": tight(tables[ends[b] : ends[b + 1]])} for b in np.flatnonzero(np.diff(ends)).tolist()]
                yield pa.RecordBatch.from_pylist(out, SENT)

    return table.select("bucket", *columns).mapInArrow(split, sql(SENT))


def listed_tables(r: dict) -> tuple[np.ndarray, np.ndarray]:
    contexts = wide(r["contexts"])
    return contexts, np.bincount(loose(r["context_at"]), loose(r["tables"]), len(contexts)).astype(np.int64)


OWNED = pa.schema([("bucket", pa.int64()), *binaries("words", "ones")])
#: owner null: the owner's own row, tables of all its words as contexts.
TOLD = pa.schema([("bucket", pa.int64()), ("owner", pa.int64()), *binaries("tables")])


def owned(key: tuple, mine: pa.Table, messages: pa.Table) -> pa.Table:
    """An owner's words, and the tables of single customers in their restaurants."""
    out = []
    for r in mine.to_pylist():
        out.append({"bucket": r["bucket"], "words": r["words"], "ones": tight(summed(wide(r["words"]), messages))})
    return pa.Table.from_pylist(out, OWNED)


def summed(words: np.ndarray, messages: pa.Table) -> np.ndarray:
    total = np.zeros(len(words), np.int64)
    for m in messages.to_pylist():
        total[np.searchsorted(words, wide(m["contexts"]))] += loose(m["tables"])
    return total


def told(key: tuple, mine: pa.Table, messages: pa.Table) -> pa.Table:
    """All tables of an owner's contexts, for itself and for each bucket that has sent some."""
    out = []
    for r in mine.to_pylist():
        words = wide(r["words"])
        total = loose(r["ones"]) + summed(words, messages)
        out.append({"bucket": r["bucket"], "owner": None, "tables": tight(total)})
        out += [{"bucket": m["bucket"], "owner": r["bucket"], "tables": tight(total[np.searchsorted(words, wide(m["contexts"]))])} for m in messages.to_pylist()]
    return pa.Table.from_pylist(out, TOLD)


def totals_of(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums over buckets of totals and tallies: a fixed number of rows."""
    out = []
    for c, n in (("totals", 5), ("tally", 4)):
        found = dict(state.select(F.posexplode(c)).groupBy("pos").agg(F.sum("col")).collect())
        out.append(np.array([found.get(i, 0) for i in range(n)], float))
    return out[0], out[1]


def sweep_with(known) -> Callable:
    """The step of a bucket, given the broadcast number of the sweep, whether to keep a sample first and to sweep then, and the totals."""

    def step(key: tuple, states: pa.Table, answers: pa.Table) -> pa.Table:
        k, sample, go_on, totals, tally = known.value
        out = []
        for r in states.to_pylist():
            s = Seating(r, totals, tally)
            if sample:
                s.record()
            if go_on:
                in_all = [loose(a["tables"]) for a in answers.sort_by("owner").to_pylist()]
                s.level.rest = (np.concatenate(in_all) if in_all else np.zeros(0, np.int64)) - s.own_tables()
                s.level.sweep(s.all_c, s.all_t, s.discount, s.up_discount, np.random.default_rng([SEED, k, s.bucket]))
            out.append(s.row())
        return pa.Table.from_pylist(out, STATE)

    return step


GIVEN = pa.schema([("segment", pa.int64()), ("bucket", pa.int64()), *binaries("seen", "parents", "tables", "pairs")])


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(FOLDS) == 0).alias("held_out"), text_or_empty().alias("text"))
    pairs, n_words, n_docs = byte_pairs(rows)
    bundles = segments(rows, spelling_model(pairs), (n_docs + 0.5) / (n_words + n_docs + 1))
    n = max(8, -(-(bundles.agg(F.sum("n_pairs")).first()[0] or 0) // BUCKET_PAIRS))
    both = written(to_buckets(bundles, n).groupBy("bucket").applyInArrow(merged, sql(MERGED)), "merged")
    places, state = both.filter("segment is not null").select("bucket", "segment", "word_at", "pair_at"), both.filter("segment is null")
    ones = sent(state, n, ("one_contexts", "one_tables"), lambda r: (wide(r["one_contexts"]), loose(r["one_tables"])))
    owners = written(state.select("bucket", "words").groupBy("bucket").cogroup(ones.groupBy("owner")).applyInArrow(owned, sql(OWNED)), "owned")
    state = state.select(*STATE.names)
    totals, tally = totals_of(state)
    left, history, spare = None, [], []  # samples to take, once the totals have settled
    samples: list[DataFrame] = []
    for k in range(MOST_SWEEPS):
        history.append(totals[:2])
        if left is None and len(history) > LAG and settled(history[-1 - LAG], totals[:2]):
            left = SAMPLES
        replies = written(owners.groupBy("bucket").cogroup(sent(state, n, ("contexts", "context_at", "tables"), listed_tables).groupBy("owner")).applyInArrow(told, sql(TOLD)), "told")
        known = spark.sparkContext.broadcast((k, left is not None, left != 1, totals, tally))
        state = written(state.groupBy("bucket").cogroup(replies.filter("owner is not null").groupBy("bucket")).applyInArrow(sweep_with(known), sql(STATE)), "seating")
        discard(*spare)
        spare = [state]
        if left is None:
            spare.append(replies)
        else:
            samples.append(replies.filter("owner is null").select("bucket", "tables"))
            left -= 1
            if not left:
                break
        totals, tally = totals_of(state)
    else:
        raise RuntimeError(f"table totals have not settled in {MOST_SWEEPS} sweeps")
    discount, n_train, n_distinct = discount_of(*tally[:2]), int(totals[2]), int(totals[3])

    def give_back(key: tuple, where: pa.Table, states: pa.Table) -> pa.Table:
        """What a segment's scores need of a bucket."""
        out, states = [], states.to_pylist()
        tables = [loose(r["tables"]) for r in states if r["seen"] is None]
        for r in (r for r in states if r["seen"] is not None):
            seen, parents = loose(r["seen"]), np.frombuffer(r["parents"], "<f4").reshape(SAMPLES, -1)
            values = np.concatenate([[0, 1 - discount], loose(r["customers"]) - discount * loose(r["drawn"]) / SAMPLES]).astype("<f4")
            for w in where.to_pylist():
                at = loose(w["word_at"])
                out.append({"segment": w["segment"], "bucket": w["bucket"], "seen": tight(seen[at]), "parents": parents[:, at].tobytes(), "tables": tight(np.concatenate([t[at] for t in tables])), "pairs": values[loose(w["pair_at"])].tobytes()})
        return pa.Table.from_pylist(out, GIVEN)

    def score(key: tuple, bundle: pa.Table, given: pa.Table) -> pa.Table:
        out, given = [], given.sort_by("bucket").to_pylist()
        together = lambda c, kind: np.concatenate([kind(g[c]).reshape(SAMPLES, -1) for g in given], 1)
        seen = np.concatenate([loose(g["seen"]) for g in given])
        parents, tables = together("parents", lambda x: np.frombuffer(x, "<f4").astype(float)), together("tables", loose)
        value = np.concatenate([np.frombuffer(g["pairs"], "<f4") for g in given]).astype(float)
        for r in bundle.to_pylist():
            tokens, size = np.frombuffer(r["tokens"], "<u4"), np.array(r["n_tokens"])
            pairs, at = np.unique(pair_codes(tokens, len(seen)), return_inverse=True)
            word, before = np.divmod(pairs, len(seen))
            p = value
            for k in range(SAMPLES):
                p = p + (STRENGTH + discount * tables[k, before]) * parents[k, word] / SAMPLES
            p = np.log10(np.maximum(p / (STRENGTH + seen[before]), 1e-300))
            base = np.log10((seen + SMOOTHING) / (n_train + SMOOTHING * (n_distinct + 1)))
            starts = np.cumsum(size) - size
            out.append(pa.table([
                pa.array(r["doc_ids"], pa.int64()), pa.array(r["held_out"], pa.bool_()), pa.array(size, pa.int64()), pa.array(np.add.reduceat((seen[tokens] > 0).astype(np.int64), starts)),
                pa.array(np.full(len(size), n_train, np.int64)), pa.array(np.add.reduceat(base[tokens], starts)), pa.array(np.add.reduceat(p[at], starts)),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    final = state.select("bucket", "seen", "parents", "customers", "drawn", F.lit(None).cast("binary").alias("tables"))
    for sample in samples:
        final = final.union(sample.select("bucket", *[F.lit(None).cast("binary")] * 4, "tables"))
    given = written(places.groupBy("bucket").cogroup(final.groupBy("bucket")).applyInArrow(give_back, sql(GIVEN)), "given")
    discard(both, state, owners, *samples)
    needed = bundles.select("segment", "doc_ids", "held_out", "n_tokens", "tokens")
    return needed.groupBy("segment").cogroup(given.groupBy("segment")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the model and under smoothed unigrams."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
