"""Deleted interpolation: n-gram shares mixed by how often their context was seen.

The probability of a token is a mixture of its shares after contexts of every length up to
``order - 1`` words, down to the uniform share. Mixture weights depend on the context's frequency
(powers of two) and are learnt by expectation-maximisation on texts that were held out of the
counts: a fixed share of the texts to learn from, so they grow with the corpus. Scoring then uses
the counts of all texts to learn from.

Counting over any number of texts: texts are tokenised into records of about 1,200,000 tokens; a
record keeps its distinct n-grams once. Sorted n-gram hashes are cut into ranges, one range of all
records is counted by one task, and counts return to each record in the order it sent its hashes.
A frequent n-gram comes once per record, however often it occurs, so no key is hot. Records are
written to the shared folder, so later passes read them and never tokenise anew.

Null texts count as empty and have one token, the end. Texts are scored whole. Rows that repeat
count and score each. A null id counts as not held out. An empty table gives an empty result.
N-grams are told apart by 64-bit hashes. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from parcelweave.llm.arrays import Texts, blocks, lower_ascii, mix
from parcelweave.llm.ship import ship
from parcelweave.session import fresh_dir

END = 0x5851F42D4C957F2D
#: Bytes of text of a record, and hashes that one task counts: what bounds memory.
RECORD_BYTES = 8_000_000
RANGE_KEYS = 1_500_000


@dataclass(frozen=True)
class Settings:
    order: int = 3
    #: One of so many texts to learn from is held out of the counts for the mixture weights.
    dev_folds: int = 32
    #: Expectation-maximisation stops after so many rounds, or when no weight moves by ``still``.
    rounds: int = 12
    still: float = 1e-3
    levels: int = 24


#: Arrays below this many bytes are packed as they are: on a very large corpus a record sends few
#: hashes to each range, and a frame would outweigh them.
PLAIN_BYTES = 512


def _pack(values: np.ndarray) -> bytes:
    """Equal-width numbers, bytes of one rank together, compressed: high bytes are nearly constant."""
    values = np.ascontiguousarray(values)
    if values.nbytes < PLAIN_BYTES:
        return b"\0" + values.tobytes()
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()
    return b"\1" + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    """The numbers of ``_pack``; nothing at all unpacks as none."""
    if raw[:1] != b"\1":
        return np.frombuffer(raw[1:], kind)
    planes = pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), "zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray, base: int) -> bytes:
    """Sorted hashes from ``base`` on as steps: only the two highest bytes of a step can be told beforehand."""
    steps = np.diff(keys, prepend=np.uint64(base))
    width = max(2, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8).T
    low, top = planes[: width - 2].tobytes(), planes[width - 2 : width].tobytes()
    packed = pa.compress(top, "zstd", asbytes=True) if len(top) >= PLAIN_BYTES else top
    return bytes([width]) + len(keys).to_bytes(4, "little") + low + packed


def _unpack_keys(raw: bytes, base: int) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:5], "little")
    cut = 5 + (width - 2) * n
    top = raw[cut:] if 2 * n < PLAIN_BYTES else pa.decompress(raw[cut:], 2 * n, "zstd", asbytes=True)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : width - 2] = np.frombuffer(raw[5:cut], np.uint8).reshape(width - 2, n).T
    steps[:, width - 2 : width] = np.frombuffer(top, np.uint8).reshape(2, n).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(base)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one; records are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def token_records(docs: DataFrame, id_col: str, text_col: str, learn: Column, dev: Column) -> DataFrame:
    """Tokenised texts in records, written to the shared folder and read back. Runs a job.

    A record holds texts of one value of ``dev`` and has ``record`` (unique), ``ids`` (an Arrow stream
    of the id column and ``learn``), ``sizes`` (tokens per text, its end included), ``words`` (distinct
    hashes, the most frequent first) and ``tokens`` (their places).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        waiting: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        held = {False: 0, True: 0}
        for batch in batches:
            for block in blocks(batch, 1, RECORD_BYTES // 4):
                for kind in waiting:
                    flag = block.column(3)
                    part = block.filter(flag if kind else pc.invert(flag))
                    if not part.num_rows:
                        continue
                    waiting[kind].append(part)
                    held[kind] += part.column(1).nbytes
                    if held[kind] >= RECORD_BYTES:
                        yield record(number, kind, waiting[kind])
                        number, waiting[kind], held[kind] = number + 1, [], 0
        for kind, rest in waiting.items():
            if rest:
                yield record(number, kind, rest)
                number += 1

    def record(number: int, kind: bool, waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        words, sizes = [], []
        for block in waiting:
            texts = Texts(block.column(1))
            low = lower_ascii(texts.codes)
            begins, ends = texts.words(low)
            hashes = texts.hashes(begins, ends, low)
            each = np.bincount(texts.owners(begins), minlength=texts.n)
            words.append(np.insert(hashes, np.cumsum(each), np.uint64(END)))
            sizes.append(each + 1)
        distinct, tokens, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        frequent = np.argsort(-times, kind="stable")
        place = np.empty(len(frequent), np.uint32)
        place[frequent] = np.arange(len(frequent), dtype=np.uint32)
        sink = pa.BufferOutputStream()
        facts = pa.Table.from_batches(waiting).select([0, 2])
        with pa.ipc.new_stream(sink, facts.schema) as stream:
            stream.write_table(facts)
        row = [number, kind, sink.getvalue().to_pybytes(), _pack(np.concatenate(sizes).astype(np.uint32))]
        row += [_pack(distinct[frequent]), _pack(place[tokens]), len(tokens)]
        return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(RECORD.names, row)})

    spark, at = docs.sparkSession, fresh_dir(docs.sparkSession, "token-records")
    chosen = docs.select(id_col, text_col, learn.alias("__learn"), dev.alias("__dev"))
    chosen.mapInArrow(run, RECORD).write.option("compression", "none").parquet(at)
    return spark.read.schema(RECORD).parquet(at)


RECORD = StructType([
    StructField("record", LongType()), StructField("dev", BooleanType()), StructField("ids", BinaryType()),
    StructField("sizes", BinaryType()), StructField("words", BinaryType()), StructField("tokens", BinaryType()),
    StructField("n_tokens", LongType()),
])


class Record:
    """A record unpacked: texts' facts, their tokens, and the distinct n-grams of every order."""

    def __init__(self, row: dict):
        with pa.ipc.open_stream(row["ids"]) as stream:
            facts = stream.read_all()
        self.ids = facts.column(0)
        self.learn = facts.column(1).to_numpy()
        self.sizes = _unpack(row["sizes"], np.uint32).astype(np.int64)
        self.words = _unpack(row["words"], np.uint64)
        self.tokens = _unpack(row["tokens"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.ends - self.sizes] = True
        self.counts = np.repeat(self.learn, self.sizes)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For order 1, 2, ...: sorted distinct hashes, and each token's place among them."""
        key = mix(self.words)
        rank = np.argsort(key)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        keys, places = key[rank], place[self.tokens]
        yield keys, places
        for k in range(2, order + 1):
            context = np.empty(len(places), np.uint64)
            context[1:] = keys[places[:-1]]
            context[self.first] = np.uint64(END)
            joint = mix(context * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + self.words[self.tokens])
            keys, places = np.unique(joint, return_inverse=True)
            yield keys, places


def _sent(settings: Settings, bits: int):
    """Hashes and own counts of every record, cut into ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                record = Record(row)
                for order, (keys, places) in enumerate(record.grams(settings.order), 1):
                    times = np.bincount(places[record.counts], minlength=len(keys)).astype(np.uint32)
                    span = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.diff(span, prepend=-1, append=-1))
                    out: dict[str, list] = {name: [] for name in SENT.names}
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        packed = _pack_keys(keys[a:b], int(span[a]) << (64 - bits))
                        values = (order, int(span[a]), row["record"], row["dev"], packed, _pack(times[a:b]))
                        for name, value in zip(SENT.names, values):
                            out[name].append(value)
                    yield pa.RecordBatch.from_pydict(out, SENT_ARROW)

    return run


SENT = StructType([
    StructField("n", IntegerType()), StructField("span", LongType()), StructField("record", LongType()),
    StructField("dev", BooleanType()), StructField("keys", BinaryType()), StructField("times", BinaryType()),
])
SENT_ARROW = pa.schema([
    ("n", pa.int32()), ("span", pa.int64()), ("record", pa.int64()), ("dev", pa.bool_()),
    ("keys", pa.binary()), ("times", pa.binary()),
])
FACTS = ("total", "total_main", "seen", "seen_main")
COUNTED = StructType([
    *SENT.fields[:4], StructField("all", BinaryType()), StructField("main", BinaryType()),
    *[StructField(c, LongType()) for c in FACTS],
])


def _counted(table: pa.Table, bits: int) -> pa.Table:
    """Totals of one range of hashes over all records, returned in each record's own order.

    ``all`` counts every text to learn from; ``main``, which only held-out records need, those that
    were not held out.
    """
    base = table.column("span")[0].as_py() << (64 - bits)
    parts = [_unpack_keys(v, base) for v in table.column("keys").to_pylist()]
    times = np.concatenate([_unpack(v, np.uint32) for v in table.column("times").to_pylist()])
    dev = table.column("dev").to_pylist()
    cuts = np.cumsum([0, *map(len, parts)])
    distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    every = np.bincount(inverse, weights=times, minlength=len(distinct)).astype(np.int64)
    times[np.repeat(dev, np.diff(cuts))] = 0
    main = np.bincount(inverse, weights=times, minlength=len(distinct)).astype(np.int64)
    own = [inverse[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    blobs = [[_pack(every[i]) for i in own], [_pack(main[i]) if d else b"" for i, d in zip(own, dev)]]
    rest = [0] * (len(own) - 1)  # the range's own numbers go with its first row
    facts = [int(every.sum()), int(main.sum()), int((every > 0).sum()), int((main > 0).sum())]
    columns = [table.column(c) for c in ("n", "span", "record", "dev")] + [pa.array(b, pa.binary()) for b in blobs]
    return pa.table(columns + [pa.array([f, *rest], pa.int64()) for f in facts], names=COUNTED.names)


class Counts:
    """Counts of every token of a record, by order: its n-gram's and its context's."""

    def __init__(self, records: pa.Table, counts: pa.Table, settings: Settings, learnt: int, of: str):
        self.record = Record(records.to_pylist()[0])
        order = counts.sort_by([("n", "ascending"), ("span", "ascending")])
        totals = np.concatenate([_unpack(v, np.int64) for v in order.column(of).to_pylist()])
        self.gram, self.context = [], [None]
        begin = 0
        for keys, places in self.record.grams(settings.order):
            self.gram.append(totals[begin : begin + len(keys)][places])
            begin += len(keys)
        for gram in self.gram[:-1]:
            before = np.empty(len(gram), np.int64)
            before[1:] = gram[:-1]
            before[self.record.first] = learnt
            self.context.append(before)

    def parts(self, total: int, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """Components of every token, uniform first, and the level of its longest context that was seen."""
        shares = [np.full(len(self.gram[0]), 1.0 / (seen + 1)), self.gram[0] / max(total, 1)]
        level = np.zeros(len(self.gram[0]), np.int64)
        for gram, context in zip(self.gram[1:], self.context[1:]):
            shares.append(gram / np.maximum(context, 1))
        last = self.context[-1] if len(self.gram) > 1 else np.full(len(level), total)
        known = last > 0
        level[known] = 1 + np.log2(last[known]).astype(np.int64)
        return np.stack(shares, axis=1), level


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray  # level x component
    total: int
    seen: int
    learnt: int

    def of_levels(self, level: np.ndarray) -> np.ndarray:
        return self.weights[np.minimum(level, len(self.weights) - 1)]


def first_weights(settings: Settings) -> np.ndarray:
    """Equal weights; a context that was never seen gives the longest n-gram none."""
    weights = np.full((settings.levels + 1, settings.order + 1), 1.0 / (settings.order + 1))
    if settings.order > 1:
        weights[0] = 1.0 / settings.order
        weights[0, -1] = 0.0
    return weights


def learn_weights(
    records: DataFrame, counted: DataFrame, settings: Settings, total: int, seen: int, learnt: int
) -> np.ndarray:
    """Expectation-maximisation over the tokens of held-out texts. Each round is one job."""
    names = [f"p{i}" for i in range(settings.order + 1)]
    schema = StructType([
        StructField("level", IntegerType()), *[StructField(c, DoubleType()) for c in names], StructField("times", LongType()),
    ])

    def shares(record: pa.Table, counts: pa.Table) -> pa.Table:
        counts = Counts(record, counts, settings, learnt, of="main")
        part, level = counts.parts(total, seen)
        use = counts.record.counts
        rows = np.column_stack([np.minimum(level[use], settings.levels), part[use]])
        table, times = np.unique(rows, axis=0, return_counts=True)
        columns = [pa.array(table[:, 0].astype(np.int32)), *[pa.array(table[:, 1 + i]) for i in range(len(names))]]
        return pa.table([*columns, pa.array(times.astype(np.int64))], names=schema.names)

    spark = records.sparkSession
    held_out = records.filter("dev").groupBy("record").cogroup(
        counted.filter("dev").select("n", "span", "record", "main").groupBy("record")
    )
    at = fresh_dir(spark, "held-out-shares")
    held_out.applyInArrow(shares, schema).write.parquet(at)
    table = spark.read.schema(schema).parquet(at)
    weights = first_weights(settings)
    for _ in range(settings.rounds):
        own = F.element_at(
            F.lit([[float(w) for w in row] for row in weights]), F.col("level") + 1
        )
        terms = [own[i] * F.col(c) for i, c in enumerate(names)]
        whole = sum(terms[1:], terms[0])
        gain = [F.sum(F.col("times") * t / F.col("whole")).alias(c) for t, c in zip([F.col(f"t{i}") for i in range(len(names))], names)]
        rows = (
            table.select("level", "times", *[t.alias(f"t{i}") for i, t in enumerate(terms)], whole.alias("whole"))
            .filter("whole > 0")
            .groupBy("level")
            .agg(*gain)
            .collect()
        )  # one row a level
        before = weights.copy()
        for row in rows:
            gains = np.array([row[c] for c in names])
            weights[row["level"]] = gains / gains.sum()
        if np.abs(weights - before).max() < settings.still:
            break
    seen_levels = sorted(row["level"] for row in rows if row["level"]) if settings.rounds else []
    for level in range(1, settings.levels + 1):
        if seen_levels and level not in seen_levels:
            weights[level] = weights[min(seen_levels, key=lambda s: (abs(s - level), s))]
    # No n-gram may become impossible: leave a trace of the uniform share.
    weights = np.maximum(weights, 1e-6 * (first_weights(settings) > 0))
    return weights / weights.sum(axis=1, keepdims=True)


def corpus_counts(records: DataFrame, settings: Settings) -> DataFrame:
    """Corpus counts of the n-grams of every record, written once to the shared folder. Runs jobs."""
    tokens = records.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(tokens / RANGE_KEYS, 1)))))
    sent = records.mapInArrow(_sent(settings, bits), SENT)
    counted = sent.groupBy("n", "span").applyInArrow(lambda table: _counted(table, bits), COUNTED)
    spark, at = records.sparkSession, fresh_dir(records.sparkSession, "n-gram-counts")
    counted.write.option("compression", "none").parquet(at)
    return spark.read.schema(COUNTED).parquet(at)


def score(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
    dev: Column | None = None,
) -> DataFrame:
    """Scores of every row by a model of the rows for which ``learn`` holds. Runs jobs when called.

    Returns ``id_col``, ``learnt``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (log10 with one
    added to every count of single tokens) and ``score`` (log10 of the mixture).
    """
    ship(docs.sparkSession)
    learn = F.coalesce(learn, F.lit(False))
    if dev is None:
        dev = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(settings.dev_folds)) == 0
    dev = learn & F.coalesce(dev, F.lit(False))
    records = token_records(docs, id_col, text_col, learn, dev)
    counted = corpus_counts(records, settings)
    facts = counted.filter("n = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FACTS]).first()
    learnt = docs.agg(F.count(F.when(learn, 1)).alias("all"), F.count(F.when(learn & ~dev, 1)).alias("main")).first()
    weights = learn_weights(records, counted, settings, facts["total_main"], facts["seen_main"], learnt["main"])
    model = Model(settings, weights, facts["total"], facts["seen"], learnt["all"])

    def run(record: pa.Table, counts: pa.Table) -> pa.Table:
        counts = Counts(record, counts, settings, model.learnt, of="all")
        part, level = counts.parts(model.total, model.seen)
        chance = (part * model.of_levels(level)).sum(axis=1)
        record, single = counts.record, counts.gram[0]
        begins = record.ends - record.sizes
        base = np.log10((single + 1) / (model.total + model.seen + 1))
        sums = [np.add.reduceat(v, begins) for v in ((single > 0).astype(np.int64), base, np.log10(chance))]
        total = np.full(len(begins), model.total, np.int64)
        columns = [record.ids, pa.array(record.learn), pa.array(record.sizes), pa.array(sums[0]), pa.array(total)]
        return pa.table([*columns, pa.array(sums[1]), pa.array(sums[2])], names=schema.names)

    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("learnt", BooleanType()),
        StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("train_tokens", LongType()),
        StructField("base_score", DoubleType()), StructField("score", DoubleType()),
    ])
    counts = counted.select("n", "span", "record", "all").groupBy("record")
    return records.groupBy("record").cogroup(counts).applyInArrow(run, schema)
