"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end of text. Those with MIN_COUNT occurrences or more and a share of 1 / HEAD of all are the vocabulary, which so
grows with the corpus; all others are leaves together by their form (letters beyond ASCII, final punctuation, length). Leaves lie in classes within
classes of BRANCH each, the more frequent nearer the root: a prefix code of lengths that follow the counts. The model gives the class at each level
from hashed n-gram and skip features of the three tokens before; a token outside the vocabulary has its add-one share of its form's count besides.

Training goes once over all training texts, in ROUNDS parts: tasks start from the broadcast weights and take gradient steps through
their share; the updates of a row of weights are averaged by the squared gradients that each task has seen there. Rows of weights grow in number with the corpus
up to MOST_BITS, which bounds what is broadcast.

Counts of tokens cover all training texts. Tokens with a share of 1 / HEAD of them or more, of which there can be no more than HEAD, are
broadcast; the others meet the texts that hold them in a join by token.

Defined cases: a null text is empty and consists of its end; a null doc_id counts as an empty one, which is trained on; repeated rows
count and are scored as often as they occur; without any training text N and V are 0, so the base score is 0, and the forms are about equally
likely; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import U64, bounded, held_out, mix64, table, text_slices, word_hashes, written

FORMS = 16
MIN_COUNT = 3
HEAD = 1 << 20
DIGIT = 4  # bits of a digit of the prefix code
BRANCH = 1 << DIGIT
LEAST_BITS, MOST_BITS = 8, 16  # of a row's number, for each feature: 21 MB of weights at most
TOKENS_PER_ROW = 32
TASK_TOKENS = 1 << 23  # training tokens of a task, about
PARTS = 64  # pieces in which the tasks' updates are averaged
FAN = 256  # updates that are summed in one group
MOVED = "part int, task int, moved binary, squares binary, summed boolean"
MOVED_NAMES = ["part", "task", "moved", "squares", "summed"]
ROUNDS, RATE = 2, 0.3
N_FEATURES = 5
ONES = np.ones(BRANCH, np.float32)
ROW = np.dtype(f"V{4 * BRANCH}")  # a row of weights as one item, which numpy puts faster
STEP = 4096
END, START = U64(0x45F3A1B2C4D5E600), U64(0x13579BDF02468AC0)
MODULUS = 7


def form(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The form class of each word: length in bytes (up to 6, up to 10, more), final punctuation, a byte beyond ASCII."""
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    wide = high[ends] > high[starts]
    last = data[ends - 1]
    stop = (last < 48) | ((last > 57) & (last < 65))
    size = ends - starts
    return ((size > 6).astype(U64) + (size > 10).astype(U64)) * U64(4) + stop.astype(U64) * U64(2) + wide.astype(U64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the rows, ends included, with the form class in the last four bits, and row offsets into them."""
    words, rows = word_hashes(texts, form)
    return np.insert(words, rows[1:], END), rows + np.arange(len(rows))


def features(toks: np.ndarray, rows: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Hashed features of what stands before each of the tokens lo to hi: the last, the one before, the third last, the last two
    together, and a constant."""
    at = np.arange(lo, hi)
    place = at - rows[np.searchsorted(rows, at, side="right") - 1]
    one, two, three = (np.where(place < n, START, toks[np.maximum(at - n, 0)]) for n in (1, 2, 3))
    return [mix64(one + U64(1)), mix64(two + U64(2)), mix64(three + U64(3)), mix64(one * U64(0x9E3779B97F4A7C15) + two + U64(4)), np.full(len(at), mix64(np.array([5], U64))[0])]


def restored(state: dict) -> Model:
    """A model from what vars() says of it: that is broadcast, so workers need no copy of this package."""
    model = Model.__new__(Model)
    vars(model).update(state)
    return model


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(codes, lengths in digits, greatest length, end of the codes) of a prefix code with BRANCH digits for leaves in falling order of counts: each length is near
    the logarithm of the count's share, as short as all together allow. Codes are of the greatest length, filled up with zeros."""
    exact = np.log(counts.sum() / counts) / np.log(BRANCH)
    low, high = 0.0, 1.0  # how much is taken off before rounding up
    lengths = np.maximum(1, np.ceil(exact)).astype(np.int64)
    for _ in range(20):
        mid = (low + high) / 2
        tried = np.maximum(1, np.ceil(exact - mid)).astype(np.int64)
        if (float(BRANCH) ** -tried).sum() <= 1:
            low, lengths = mid, tried
        else:
            high = mid
    longest = int(lengths.max())
    widths = np.int64(1) << (DIGIT * (longest - lengths))
    ends = np.cumsum(widths)
    return ends - widths, lengths, longest, int(ends[-1])


class Model:
    """vocab: token hashes, sorted; leaf: their leaves; form_totals: what add-one shares of a form's tokens are of; a row of weights serves
    the digits below one node for one feature."""

    def __init__(self, vocab: np.ndarray, counts: np.ndarray, form_totals: np.ndarray, row_bits: int = LEAST_BITS):
        order = np.argsort(vocab)
        self.vocab, self.form_totals, self.row_bits = vocab[order], form_totals, row_bits
        every = np.concatenate([form_totals, counts[order]]).astype(float)
        ranked = np.argsort(-every, kind="stable")
        self.codes, self.lengths = np.empty(len(every), np.int64), np.empty(len(every), np.int64)
        self.codes[ranked], self.lengths[ranked], self.longest, self.end = prefix_code(every[ranked])
        self.weights = np.zeros((N_FEATURES, 1 << row_bits, BRANCH), np.float32)

    def leaves(self, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each token, whether it is in the vocabulary)."""
        forms = (toks & U64(15)).astype(np.int64)
        if not len(self.vocab):
            return forms, np.zeros(len(toks), bool)
        at = np.minimum(np.searchsorted(self.vocab, toks), len(self.vocab) - 1)
        known = self.vocab[at] == toks
        return np.where(known, at + FORMS, forms), known

    def _paths(self, leaves: np.ndarray, feats: np.ndarray):
        """(token, digit, rows of weights by feature, how many digits the node has) of each node on the tokens' paths."""
        lengths = self.lengths[leaves]
        token = np.repeat(np.arange(len(leaves)), lengths)
        depth = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        below = DIGIT * (self.longest - 1 - depth)
        down = self.codes[leaves][token] >> below
        base = down >> DIGIT
        node = mix64(base.view(U64) * U64(0x9E3779B97F4A7C15) + depth.view(U64))
        # Codes fill the tree from one side, so only nodes at its edge lack digits.
        digits = np.minimum(BRANCH, ((self.end - 1) >> below) - (base << DIGIT) + 1)
        shift = U64(64 - self.row_bits)
        rows = [(((f[token] ^ node) * U64(0xD6E8FEB86659FD93)) >> shift).astype(np.uint16) for f in feats]
        return token, down & (BRANCH - 1), rows, digits

    def _scores(self, rows: list[np.ndarray], digits: np.ndarray) -> np.ndarray:
        """Sums of weights; those of a row sum to zero, as its gradients do, so no exponent of them is out of reach but one too large."""
        total = self.weights[0].take(rows[0], axis=0)
        held = np.empty_like(total)
        for table, r in zip(self.weights[1:], rows[1:], strict=True):
            total += table.take(r, axis=0, out=held, mode="clip")
        np.minimum(total, np.float32(80), out=total)
        edge = np.flatnonzero(digits < BRANCH)
        if len(edge):
            total[edge] = np.where(np.arange(BRANCH) < digits[edge][:, None], total[edge], np.float32(-1e9))
        return total

    def logs(self, toks: np.ndarray, rows: np.ndarray, lo: int, hi: int, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of the leaves of tokens lo to hi, and whether these are in the vocabulary. found: leaves() of them, if it is known."""
        leaves, known = self.leaves(toks[lo:hi]) if found is None else found
        token, digit, at, digits = self._paths(leaves, features(toks, rows, lo, hi))
        scores = self._scores(at, digits)
        own = scores.ravel().take(np.arange(len(token)) * BRANCH + digit)
        return np.bincount(token, own - np.log(np.exp(scores, out=scores) @ ONES), hi - lo) / np.log(10), known

    def train(self, toks: np.ndarray, rows: np.ndarray, squares: np.ndarray) -> None:
        """Gradient steps over STEP tokens each, scaled by the root of the summed squares of the gradients (squares, updated)."""
        for lo in range(0, len(toks), STEP):
            hi = min(len(toks), lo + STEP)
            token, digit, at, digits = self._paths(self.leaves(toks[lo:hi])[0], features(toks, rows, lo, hi))
            grad = self._scores(at, digits)
            np.exp(grad, out=grad)
            grad /= -(grad @ ONES)[:, None]
            grad.ravel()[np.arange(len(token)) * BRANCH + digit] += 1
            for table, sums, r in zip(self.weights, squares, at, strict=True):
                order = np.argsort(r, kind="stable")
                ranked = r[order]
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                # Most rows are met once, and their gradients taken as they are. Of the others, two are added at a time, as parts of a complex number.
                size = np.diff(first, append=len(order))
                total = grad.take(order.take(first), axis=0)
                many = np.flatnonzero(size > 1)
                if len(many):
                    met = order[np.repeat(size > 1, size)]
                    start = np.cumsum(size[many]) - size[many]
                    total[many] = np.add.reduceat(grad.take(met, axis=0).view(np.complex64), start, axis=0).view(np.float32)
                own = ranked[first].astype(np.int64)
                held = sums.take(own) + np.einsum("ij,ij->i", total, total) / np.float32(BRANCH)
                sums[own] = held
                total *= (np.float32(RATE) / np.sqrt(held + np.float32(1)))[:, None]
                total += table.take(own, axis=0)
                table.view(ROW).ravel().put(own, total.view(ROW).ravel())


def _count_tokens(batches):
    held, size = [], 0

    def emit():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    for batch in batches:
        for _, texts in text_slices(batch, "text"):
            held.append(tokens(texts)[0])
            size += len(held[-1])
            if size > 4_000_000:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()


def count(training: DataFrame) -> DataFrame:
    """(h, c): the hashes of the tokens of the texts and how often they occur."""
    return written(training.select("text").mapInArrow(_count_tokens, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "counts")


def _train_task(shared):
    def run(batches):
        model = restored(shared.value)
        start, model.weights = model.weights, model.weights.copy()
        squares = np.zeros(start.shape[:2], np.float32)
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                model.train(*tokens(texts), squares)
        moved = model.weights - start
        if squares.any():
            pieces = [x.astype(np.float16).tobytes() for x in np.array_split(moved.reshape(-1, BRANCH), PARTS)]
            weigh = [x.tobytes() for x in np.array_split(squares.ravel(), PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array(pieces, pa.binary()), pa.array(weigh, pa.binary()), pa.array([False] * PARTS)], names=MOVED_NAMES)

    return run


def _summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of one part: the sum of the tasks' updates, each row's weighted by the squared gradients that they saw there, and the sum of the weights."""
    total, weight = 0.0, 1e-20
    for x, w, summed in zip(group.column("moved"), group.column("squares"), group.column("summed"), strict=True):
        w = np.frombuffer(w.as_buffer(), np.float32)
        x = np.frombuffer(x.as_buffer(), np.float32 if summed.as_py() else np.float16).astype(np.float32).reshape(-1, BRANCH)
        total = total + (x if summed.as_py() else x * w[:, None])
        weight = weight + w
    return total, weight


def _sum(group: pa.Table) -> pa.Table:
    total, weight = _summed(group)
    first = lambda c: group.column(c).slice(0, 1).combine_chunks()
    return pa.table([first("part"), first("task"), pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([weight.astype(np.float32).tobytes()], pa.binary()), pa.array([True])], names=MOVED_NAMES)


def _mean(group: pa.Table) -> pa.Table:
    total, weight = _summed(group)
    return pa.table([pa.array([group.column("part")[0].as_py()], pa.int32()), pa.array([(total / weight[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["part", "moved"])


def averaged(moved: DataFrame, tasks: int, fan: int = FAN) -> DataFrame:
    """(part, moved): the mean of the updates of up to `tasks` tasks. No group holds more than `fan` of them: sums of so many are summed again."""
    while tasks > fan:
        moved = moved.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("part", "task").applyInArrow(_sum, MOVED)
        tasks = -(-tasks // fan)
    return moved.groupBy("part").applyInArrow(_mean, "part int, moved binary")


def fit(training: DataFrame, counts: DataFrame) -> tuple[Model, int, int, tuple[np.ndarray, np.ndarray]]:
    """(model, N, V, (hashes, counts) of the common tokens by hash). counts must be written: it is read several times."""
    spark = training.sparkSession
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    common = counts.where(F.col("c") * HEAD >= n).toArrow()
    h, c = (common.column(x).to_numpy().astype(np.int64) for x in ("h", "c"))
    order = np.argsort(h)
    head = h[order], c[order]
    vocabulary = c >= MIN_COUNT
    by_form = counts.groupBy(F.col("h").bitwiseAND(F.lit(15)).alias("f")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    form_totals = np.ones(FORMS)
    for r in by_form:
        form_totals[r["f"]] += r["c"] + r["v"]
    np.subtract.at(form_totals, h[vocabulary] & 15, c[vocabulary] + 1)
    row_bits = min(MOST_BITS, max(LEAST_BITS, (n // TOKENS_PER_ROW).bit_length()))
    model = Model(h[vocabulary].view(U64), c[vocabulary], form_totals, row_bits)
    # Tasks grow in number with the tokens, not in size; their updates are averaged by part, and one model's worth comes back.
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // (TASK_TOKENS * ROUNDS)))
    for turn in range(ROUNDS if n else 0):
        shared = spark.sparkContext.broadcast(vars(model))
        texts = training.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).coalesce(tasks)
        moved = texts.mapInArrow(_train_task(shared), MOVED)
        got = sorted(averaged(moved, tasks).collect(), key=lambda r: r["part"])
        shared.unpersist()
        if got:
            model.weights = model.weights + np.frombuffer(b"".join(bytes(r["moved"]) for r in got), np.float32).reshape(model.weights.shape)
    return model, n, v, head


def score(docs: DataFrame, model: Model, counts: DataFrame, n: int, v: int, head: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, base_score and score (log10 probabilities)."""
    spark = docs.sparkSession
    # All words of the vocabulary are common, so the place of a token among the common ones tells its leaf too.
    leaf, inside = model.leaves(head[0].view(U64))
    shared = spark.sparkContext.broadcast((vars(model) | {"vocab": np.zeros(0, U64)}, *head, np.where(inside, leaf, -1).astype(np.int32), float(np.log10(n + v + 1))))
    kept = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    fields = ", ".join(f"k{i} {kept.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        state, hashes, freqs, leaf, log_all = shared.value
        model = restored(state)
        log_form = np.log10(model.form_totals)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                toks, rows = tokens(texts)
                base, own, n_known = (np.zeros(len(texts)) for _ in range(3))
                outside = []  # tokens beyond the head, with their rows
                for lo in range(0, len(toks), STEP):
                    hi = min(len(toks), lo + STEP)
                    signed, row = toks[lo:hi].view(np.int64), np.searchsorted(rows, np.arange(lo, hi), side="right") - 1
                    at = np.minimum(np.searchsorted(hashes, signed), max(0, len(hashes) - 1))
                    known = hashes[at] == signed if len(hashes) else np.zeros(hi - lo, bool)
                    inside = known & (leaf[at] >= 0) if len(hashes) else known
                    leaves = np.where(inside, leaf[at], signed & 15) if len(hashes) else signed & 15
                    logs, _ = model.logs(toks, rows, lo, hi, (leaves, inside))
                    gain = np.where(known, np.log10(freqs[at] + 1.0), 0.0) if len(hashes) else np.zeros(hi - lo)
                    # log10(c + 1) of the tokens beyond the head is added after the join.
                    logs += np.where(inside, 0.0, gain - log_form[signed & 15])
                    for total, x in ((base, gain - log_all), (own, logs), (n_known, known)):
                        total[row[0] : row[-1] + 1] += np.bincount(row - row[0], x)
                    outside.append(np.stack([row[~known], signed[~known]]))
                rest, rest_n = [], []
                found = np.concatenate(outside, axis=1) if outside else np.zeros((2, 0), np.int64)
                edges = np.searchsorted(found[0], np.arange(len(texts) + 1))
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    values, times = np.unique(found[1, lo:hi], return_counts=True)
                    rest.append(values)
                    rest_n.append(times)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in names), pa.array(np.diff(rows)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(own), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rest))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rest_n).astype(np.int32)))],
                    names=[*names, "n_tokens", "n_known", "base", "own", "rest", "rest_n"],
                )

    scored = kept.mapInArrow(run, f"{fields}, n_tokens long, n_known long, base double, own double, rest array<long>, rest_n array<int>")
    scored = written(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    tail = scored.select("uid", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("uid", F.col("x.rest").alias("h"), F.col("x.rest_n").alias("times"))
    # No token beyond the head is a hot key: each has less than a share of 1 / HEAD of all training tokens.
    met = tail.join(counts.where(F.col("c") * HEAD < n), "h").groupBy("uid").agg(F.sum("times").cast("long").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain"))
    out = scored.drop("rest", "rest_n").join(met, "uid", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return out.select(*[F.col(x).alias(c) for x, c in zip(names, keep, strict=True)], "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + gain).alias("base_score"), (F.col("own") + gain).alias("score"))


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), MODULUS))
    training = docs.where(~F.col("held_out"))
    counts = count(training)
    model, n, v, head = fit(training, counts)
    out = score(docs, model, counts, n, v, head, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
