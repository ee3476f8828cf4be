"""Same or nearly the same records across splits: a weighted cosine join over inverted lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import kernel, languages
from ledgerloom.session import discard, durable, spread

#: Least cosine of two records, and the blocks of a vector with their shares of its squared norm: words and figures of the
#: context (two blocks), and of the question the words that name lines of the report, the periods and the kind. A block without a
#: term holds one that says so, hence every block has its full share, and the least cosine asks for 0.7 within the context and
#: 0.8 within the question.
MIN_COSINE = 0.88
BLOCKS, SHARES, IN_CONTEXT = ("words", "figures", "names", "periods", "kind"), np.array([0.2, 0.2, 0.2, 0.2, 0.2]), 2
_FIGURES = BLOCKS.index("figures")
#: Order of the blocks in the lists: figures tell pages apart best, so the words of a context are hardly ever looked up.
_ORDER = np.array([1, 0, 2, 2, 2])
#: Terms of more than one record in ``FREQUENT`` are weighed from a table that every task gets: at most ``FREQUENT`` times the
#: mean number of terms of a record, whatever the number of records. All other terms are weighed by a join on the term.
FREQUENT = 1000
#: Records of either side that one part of a list holds; longer lists are split, and each part of one side meets each of the other.
LIST_ROWS = 20_000
#: Rows that a task packs at a time, and pairs that it holds at a time.
PACK_ROWS, PAIRS = 1 << 16, 1 << 20
#: What the lists may move at once, in whole records as a multiple of the table or in bytes, whichever is more; beyond that they take
#: several rounds. Where the words of the contexts stay behind, it is about half of that.
MOVED, ROOM = 2.5, 1 << 27
EVAL_SPLITS = ("dev", "test")

_PERIOD = re.compile(r"\b(?:19|20)\d\d(?:-\d\d-\d\d)?\b")
_ESCAPES = re.compile(r"\\+[nrt]")
#: Kinds of question by the words that ask for them, tried in this order.
KINDS = (
    ("percent", re.compile(r"percent|prozent|porcent|pourcent|growth rate|\bgrowth\b|wachstum|crecimiento|croissance|%")),
    ("mean", re.compile(r"\baverage|\bmean\b|mittelwert|durchschnitt|promedio|\bmedia\b|moyenne")),
    ("ratio", re.compile(r"\bratio\b|\bshare\b|\bportion\b|\bproportion\b|verhältnis|anteil|proporción|\bparte\b|relación|\bpart\b|rapport|as a share")),
    ("sum", re.compile(r"\bsum\b|\btotal (?:of|de|von)\b|together|combined|\bsumme\b|zusammen|\bsuma|juntos|\bsomme\b|ensemble|réunie?s")),
    ("difference", re.compile(r"chang|differ|add or lose|gain|thousand|unterschied|tausend|diferencia|miles|différence|milliers|écart")),
)


#: Words that ask rather than name a line of the report; with function words they are left out of what a question asks for.
ASKING = frozenset(
    "percent percentage change changed growth rate relative average mean ratio share portion proportion total sum summed combined together differ difference add lose gain thousands thousand "
    "move moved large represent represented according report please answer question taking adding average across q a to many find tell calculate compute give us me using based table context year years "
    "prozent prozentuale prozentualen veränderung verändert änderung änderte ändert ergibt ergab hoch hohe groß große betrag welche welchen welcher welches mittelwert durchschnitt verhältnis anteil summe zusammen unterschied tausend hatte betrug betrugen jahr jahren insgesamt "
    "variación porcentual porcentaje cambió promedio media proporción parte relación suma sumaron diferencia miles representaba representó hubo año años "
    "variation pourcentage moyenne part rapport somme ensemble réunis réunies différence milliers écart changé varié représentait année années t il fait".split()
)


_NAMES = re.compile(r"[^\W\d_]+", re.U)
_TOKENS = re.compile(r"[^\W_]+", re.U)


def reading(question: str | None) -> tuple[str, str, str]:
    """The words of a question that name lines of the report, its periods, and its kind; each empty where there is none.

    A question that names nothing is taken by all its words.
    """
    q = re.sub(r"\s+", " ", _ESCAPES.sub(" ", question or "")).lower()
    words = [w for w in _NAMES.findall(_PERIOD.sub(" ", q)) if w not in ASKING and w not in languages._WEIGHT]
    kind = next((name for name, rx in KINDS if rx.search(q)), "")
    return " ".join(words or _TOKENS.findall(q)), " ".join(sorted(set(_PERIOD.findall(q)))), kind


def gold_value(gold: str | None) -> float | None:
    """The number in a gold answer, percent signs applied; None if there is none."""
    if not gold:
        return None
    g = _ESCAPES.sub(" ", gold).replace("−", "-").replace(",", "").strip()
    m = re.fullmatch(r"(\()?\s*(-?)\s*[$€£]?\s*(-?\d+(?:\.\d+)?(?:e-?\d+)?)\s*(%|percent)?\s*(\))?", g, re.I)
    if not m:
        return None
    value = float(m[3]) * (-1 if m[1] or m[2] else 1)
    return value / 100 if m[4] else value


def _records(examples: DataFrame, eval_splits: tuple[str, ...]) -> DataFrame:
    """The records of the wanted splits with their class; the first of each class also has its terms (distinct hashes per block, ascending) with damped counts and blocks.

    Texts are read once, and a record's terms move once, packed: rows of plain lists would take twice the room.
    """
    split = F.lower(F.trim("split"))
    src = examples.select(F.col("id"), split.alias("split"), "gold_source", "question", "context", "gold")
    src = src.where(split.isin("train", *eval_splits) & F.col("id").isNotNull())
    buckets = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        questions = b.column(3).dictionary_encode()
        known = [reading(q) for q in questions.dictionary.to_pylist()] + [reading(None)]
        which = pc.fill_null(questions.indices, len(known) - 1)
        texts = (b.column(4), *(pa.array(x, pa.string()).take(which) for x in zip(*known)))
        said, *asked = map(kernel.words, texts)
        number = said.is_number()
        found = [(said.hash[x], said.row[x]) for x in (~number, number)] + [(w.hash, w.row) for w in asked]
        none = [np.setdiff1d(np.arange(b.num_rows), row) for _, row in found]
        found = [(np.concatenate([h, np.zeros(len(x), np.uint64)]), np.concatenate([row, x])) for (h, row), x in zip(found, none)]
        hashes = np.concatenate([kernel.mix(h + np.uint64(k + 1)) for k, (h, _) in enumerate(found)]).view(np.int64)
        rows, blocks = np.concatenate([row for _, row in found]), np.repeat(np.arange(len(found)), [len(row) for _, row in found])
        order = np.lexsort((hashes, rows))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(rows[order]) != 0) | (np.diff(hashes[order]) != 0)])) if len(order) else order
        count = np.diff(np.append(first, len(order)))
        own = order[first]
        begin = np.searchsorted(rows[own], np.arange(b.num_rows + 1))
        gold = pa.array([gold_value(x) for x in b.column(5).to_pylist()], pa.float64())
        train = pc.equal(b.column(1), "train")
        each = kernel.mix(hashes[own].view(np.uint64) + kernel.mix(count.astype(np.uint64)))
        cls = np.add.reduceat(each, begin[:-1]) if b.num_rows else each
        cls ^= kernel.mix(pc.fill_null(gold, np.nan).to_numpy().view(np.uint64) + np.uint64(1) + train.to_numpy(zero_copy_only=False))
        values = (pa.array(hashes[own]), pa.array((1 + np.log(count)).astype(np.float32)), pa.array(blocks[own].astype(np.int8)))
        cols = [*b.columns[:3], pa.array(kernel.mix(cls).view(np.int64)), train, gold, *(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), v) for v in values)]
        return pa.RecordBatch.from_arrays(cols, _RECORD)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def rows() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for b in batches:
                b = read(b)
                new = _new(b, seen)
                # Further members have no terms and go anywhere, so that a class of very many is no load on one task.
                yield _without(b, ~new), np.where(new, b.column(3).to_numpy() % buckets, np.arange(b.num_rows) % buckets).astype(np.int32)

        yield from _pack(rows())

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _unpack(batches):
            yield _without(b, ~_new(b, seen))

    packed = spread(src).mapInArrow(send, "bucket int, blob binary")
    return packed.repartitionById(buckets, "bucket").mapInArrow(receive, "id string, split string, gold_source string, cls long, train boolean, gold double, terms array<bigint>, counts array<float>, blocks array<tinyint>")


_RECORD = ["id", "split", "gold_source", "cls", "train", "gold", "terms", "counts", "blocks"]


def _new(b: pa.RecordBatch, seen: set[int]) -> np.ndarray:
    """Which records have terms and are the first of their class; ``seen`` takes their classes, a number each."""
    new = np.zeros(b.num_rows, bool)
    valid, classes = b.column(6).is_valid().to_numpy(zero_copy_only=False), b.column(3).to_pylist()
    for k, c in enumerate(classes):
        if valid[k] and c not in seen:
            seen.add(c)
            new[k] = True
    return new


def _without(b: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    """Records without their terms where ``rows`` says so."""
    if not rows.any():
        return b
    lists = [pc.if_else(pa.array(rows), pa.scalar(None, c.type), c) for c in b.columns[6:]]
    return pa.RecordBatch.from_arrays([*b.columns[:6], *lists], _RECORD)


def _pack(rows: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows with their buckets as one compressed table per bucket, for up to ``PACK_ROWS`` rows at a time."""
    held, buckets, n = [], [], 0

    def out() -> pa.RecordBatch:
        table, bucket = pa.Table.from_batches(held).combine_chunks(), np.concatenate(buckets)
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        blobs = []
        for a, z in zip(first, np.append(first[1:], len(order))):
            sink = pa.BufferOutputStream()
            pq.write_table(table.take(pa.array(order[a:z])), sink, compression="zstd", write_statistics=False, store_schema=False)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    for b, bucket in rows:
        if b.num_rows:
            held, buckets, n = [*held, b], [*buckets, bucket], n + b.num_rows
        if n >= PACK_ROWS:
            yield out()
            held, buckets, n = [], [], 0
    if n:
        yield out()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column(1):
            yield from pq.read_table(pa.BufferReader(blob.as_buffer()), use_threads=False).combine_chunks().to_batches()


def _lists(column: pa.Array) -> tuple:
    """The values of a column of lists end to end, and the record of each value."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    return values if pa.types.is_struct(values.type) else values.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


class Frequent:
    """Of the frequent terms: how many records of either side have them, and a bound on the weight on either side."""

    def __init__(self, n: int, terms: np.ndarray, train: np.ndarray, held: np.ndarray):
        order = np.argsort(terms)
        self.n, self.terms, self.train, self.held = n, terms[order], train[order], held[order]
        self.most = np.ones((2, len(terms)))

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``terms`` are in the table, and the rows of those."""
        if not len(self.terms):
            return np.zeros(len(terms), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return there, at[there]


def _counted(reps: DataFrame, cap: int) -> tuple[DataFrame, Frequent]:
    """How many classes of either side have each term (of terms that more than one has), and the table of the frequent ones."""
    n = max(reps.count(), 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, rec = _lists(b.column(1))
            found, at = np.unique(terms, return_inverse=True)
            train = np.bincount(at, b.column(0).to_numpy(zero_copy_only=False)[rec], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(train), pa.array(np.bincount(at, minlength=len(found)) - train)], ["t", "nt", "ne"])

    df = reps.select("train", "terms").mapInArrow(counted, "t long, nt long, ne long").groupBy("t").agg(F.sum("nt").alias("nt"), F.sum("ne").alias("ne"))
    df = durable(df.where(F.col("nt") + F.col("ne") > 1), "terms")
    top = df.where(F.col("nt") + F.col("ne") > F.lit(n / cap)).toArrow()
    return df, Frequent(n, *(top[c].to_numpy() for c in ("t", "nt", "ne")))


def _weighted(reps: DataFrame, df: DataFrame, frequent: Frequent, cap: int) -> DataFrame:
    """The vector of every class of ``reps``: ``terms``, weights ``w`` and blocks.

    Inverse document frequency is exact: a term of one class is told by its absence from the counts, frequent terms come from
    a table of bounded size, the others from a join on the term, in which no key has more than one class in ``cap``.
    """
    shared = reps.sparkSession.sparkContext.broadcast(frequent)
    often = F.col("nt") + F.col("ne") > F.lit(frequent.n / cap)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, rec = _lists(b.column(1))
            use = ~shared.value.places(terms)[0]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rec[use])), pa.array(terms[use])], ["cls", "t"])

    rare = reps.select("cls", "terms").mapInArrow(others, "cls long, t long").join(df.where(~often), "t").groupBy("cls").agg(F.collect_list(F.struct("t", (F.col("nt") + F.col("ne")).alias("n"))).alias("rare"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            terms, rec = _lists(b.column(2))
            counts, blocks = (_lists(b.column(k))[0] for k in (3, 4))
            there, at = table.places(terms)
            count = np.ones(len(terms), np.int64)
            count[there] = table.train[at] + table.held[at]
            known, of = _lists(b.column(5))
            if len(of):
                known, times = (known.field(k).to_numpy() for k in range(2))
                # Terms are ascending within a record, so a record's known terms are found by one search over (record, term).
                count[_find(rec, terms, of, known)] = times
            w = counts * np.log1p(table.n / count)
            cell = rec * len(BLOCKS) + blocks
            size = np.sqrt(np.bincount(cell, w * w, minlength=b.num_rows * len(BLOCKS)))
            ends = pa.array(np.searchsorted(rec, np.arange(b.num_rows + 1)), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (terms, w / size[cell] * np.sqrt(SHARES)[blocks], blocks))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *lists], ["cls", "gold", "terms", "w", "blocks"])

    rows = reps.join(rare, "cls", "left").select("cls", "gold", "terms", "counts", "blocks", "rare")
    return rows.mapInArrow(run, "cls long, gold double, terms array<bigint>, w array<double>, blocks array<tinyint>")


def _find(rec: np.ndarray, terms: np.ndarray, of: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The positions of the terms ``known`` of the records ``of`` among ``terms`` of ``rec``, both ascending in record and term."""
    pairs = np.empty(len(rec), [("r", np.int64), ("t", np.int64)])
    pairs["r"], pairs["t"] = rec, terms
    wanted = np.empty(len(of), pairs.dtype)
    wanted["r"], wanted["t"] = of, known
    both = np.concatenate([pairs, wanted])
    order = np.lexsort((np.arange(len(both)), both["t"], both["r"]))
    at = np.empty(len(both), np.int64)
    at[order] = np.arange(len(both))
    return order[at[len(rec) :] - 1]  # the copy in ``terms`` stands right before the wanted one


def prefixes(train: np.ndarray, terms: np.ndarray, w: np.ndarray, nt: np.ndarray, ne: np.ndarray, blocks: np.ndarray, rec: np.ndarray, n: int, frequent: Frequent, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the context that must be looked up, those of the question, and what the rest of each record can add to a product.

    Terms run from rare to frequent within the figures, the words of the context, and the question. The rest of either stays out of the lists once no
    vector of the other side can reach ``least`` with it, all of the other part granted. Two bounds hold for that product: the
    norm of the terms that the other side has at all, times the full share of the block, and the sum of the weights by the
    greatest weight of each term on the other side.
    """
    most = np.where(np.where(train[rec], ne, nt) > 0, 1.0, 0.0)
    there, at = frequent.places(terms)
    most[there] = frequent.most[(~train[rec[there]]).astype(np.int64), at]

    def left_over(x: np.ndarray) -> np.ndarray:
        run = np.cumsum(x)
        total = np.bincount(rec, x, minlength=n)
        return np.maximum(np.cumsum(total)[rec] - run + x, 0)  # what a record has from this term on

    met, product, asked = w * (most > 0), w * most, blocks >= IN_CONTEXT
    tail = np.zeros((2, len(w)))  # of the context, of the question
    for k, share in enumerate(SHARES):
        tail[int(k >= IN_CONTEXT)] += np.minimum(np.minimum(np.sqrt(share * left_over(np.where(blocks == k, met * met, 0))), left_over(np.where(blocks == k, product, 0))), share)
    whole = np.zeros((2, n))
    np.maximum.at(whole[0], rec, tail[0])
    np.maximum.at(whole[1], rec, tail[1])
    use = (tail[asked.astype(np.int64), np.arange(len(w))] + whole[(~asked).astype(np.int64), rec] >= least - 1e-6) & (whole.sum(0)[rec] >= least - 1e-6)
    rest = np.zeros(n)
    np.maximum.at(rest, rec[~asked & ~use], tail[0][~asked & ~use])
    use &= most > 0
    return np.flatnonzero(use & ~asked), np.flatnonzero(use & asked), rest + whole[1]


class Bounds:
    """Upper bounds on the weights of a batch of records, from the table of the frequent terms alone.

    A term outside the table is in one class at least and in one of ``cap`` at most; its weight is taken as the greatest that
    this leaves open. Terms run by record: figures, words of the context, terms of the question, each from rare to frequent.
    """

    def __init__(self, terms: np.ndarray, rec: np.ndarray, counts: np.ndarray, blocks: np.ndarray, train: np.ndarray, n: int, table: Frequent, cap: int):
        there, at = table.places(terms)
        nt, ne = np.ones((2, len(terms)), np.int64)
        nt[there], ne[there] = table.train[at], table.held[at]
        low, high = (np.full(len(terms), np.log1p(x)) for x in (min(table.n, cap), table.n))
        low[there] = high[there] = np.log1p(table.n / (nt[there] + ne[there]))
        low, high = np.square(counts * low), np.square(counts * high)
        cell = rec * len(BLOCKS) + blocks
        size = np.bincount(cell, low, minlength=n * len(BLOCKS))
        w = np.sqrt(SHARES[blocks] * high / np.maximum(size[cell] - low + high, 1e-300))
        # Terms are ascending within a record, and the sort is stable, so terms of one count have one order everywhere.
        rank = np.where(there, nt + ne, 0)
        order = np.argsort((rec * (max(_ORDER) + 1) + _ORDER[blocks]) * (table.n + 1) + rank, kind="stable")
        self.n, self.train = n, train
        self.terms, self.rec, self.w, self.nt, self.ne, self.blocks = (x[order] for x in (terms, rec, w, nt, ne, blocks))

    def prefixes(self, table: Frequent, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return prefixes(self.train, self.terms, self.w, self.nt, self.ne, self.blocks, self.rec, self.n, table, least)


def _expand(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions repeated ``times`` each, and the number of each repetition from 0."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def keys(b: Bounds, table: Frequent, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each record, as records and hashes: two records that reach ``least`` share a list, by what they ask.

    Where ``least`` can't be reached without a block of the question, two such records share a term in the prefix of that block; a
    list has one such term of each block. Where it can, a list has one term of the question, from its prefix as a whole.
    """
    need = (least - (1 - SHARES)) / SHARES
    asked = [k for k in range(IN_CONTEXT, len(BLOCKS)) if need[k] > 1e-6]
    if not asked:
        at = b.prefixes(table, least)[1]
        return b.rec[at], kernel.mix(b.terms[at].view(np.uint64)).view(np.int64)
    rec, key = np.arange(b.n), np.zeros(b.n, np.uint64)
    for k in asked:
        at = _prefix(b, k, need[k])[0]
        n = np.bincount(b.rec[at], minlength=b.n)
        i, j = _expand(n[rec])
        term = b.terms[at[(np.cumsum(n) - n)[rec[i]] + j]]
        rec, key = rec[i], kernel.mix(kernel.mix(key[i]) ^ term.view(np.uint64))
    return rec, key.view(np.int64)


def _prefix(b: Bounds, k: int, need: float) -> tuple[np.ndarray, np.ndarray]:
    """The terms of block ``k`` without which its cosine can't reach ``need``, and what the others of a record can add to a product."""
    at = np.flatnonzero(b.blocks == k)
    rec = b.rec[at]
    x = np.where(np.where(b.train[rec], b.ne[at], b.nt[at]) > 0, np.square(b.w[at]), 0.0)
    left = np.maximum(np.cumsum(np.bincount(rec, x, minlength=b.n))[rec] - np.cumsum(x) + x, 0)
    use = left >= SHARES[k] * max(need - 1e-6, 0) ** 2
    rest = np.zeros(b.n)
    np.maximum.at(rest, rec[~use], np.minimum(np.sqrt(SHARES[k] * left[~use]), SHARES[k]))
    return at[use & (x > 0)], rest


def _by_figures(least: float) -> bool:
    """Whether no pair can reach ``least`` without figures: then the words of the contexts need not move."""
    return least - (1 - SHARES[_FIGURES]) > 1e-6


def _asking(b: pa.RecordBatch, table: Frequent, cap: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``keys`` of a batch of ``cls``, ``train``, ``terms``, ``counts``, ``blocks``; where blocks decide, from the terms of the question alone."""
    terms, rec = _lists(b.column(2))
    counts, blocks = (_lists(b.column(k))[0] for k in (3, 4))
    if np.any(least - (1 - SHARES[IN_CONTEXT:]) > 1e-6):
        use = blocks >= IN_CONTEXT
        terms, rec, counts, blocks = terms[use], rec[use], counts[use], blocks[use]
    return keys(Bounds(terms, rec, counts, blocks, b.column(1).to_numpy(zero_copy_only=False), b.num_rows, table, cap), table, least)


def _candidates(reps: DataFrame, size: int, frequent: Frequent, cap: int, least: float) -> DataFrame:
    """Pairs of classes ``cls_t``, ``cls_e`` of which no bound says that they stay below ``least``.

    The records of a list meet in one task. They move packed, once for each task that has lists of theirs; if all lists together
    would move much more than the table of ``size`` bytes, they are done in rounds, each with its part of them, so the disk needed at a time is bounded.
    """
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(frequent)
    buckets, most = int(spark.conf.get("spark.sql.shuffle.partitions")), LIST_ROWS
    rows = reps.select("cls", "train", "terms", "counts", "blocks", "gold")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec, key = _asking(b, shared.value, cap, least)
            found, at = np.unique(key, return_inverse=True)
            train = np.bincount(at, b.column(1).to_numpy(zero_copy_only=False)[rec], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(train), pa.array(np.bincount(at, minlength=len(found)) - train)], ["key", "nt", "ne"])

    lists = rows.drop("gold").mapInArrow(sizes, "key long, nt long, ne long").groupBy("key").agg(F.sum("nt").alias("nt"), F.sum("ne").alias("ne"))
    lists = durable(lists.where((F.col("nt") > 0) & (F.col("ne") > 0)).select("key", *[F.ceil(F.col(c) / most).alias(f"p{c[1]}") for c in ("nt", "ne")], "nt", "ne"), "lists", tidy=True)
    moved = lists.select(F.sum(F.col("nt") * F.col("pe") + F.col("ne") * F.col("pt"))).first()[0] or 0
    # Lists of more parts are fewer than the lists' rows by the rows of a part; the rest have one part.
    long = lists.where((F.col("pt") > 1) | (F.col("pe") > 1)).select("key", "pt", "pe").toArrow().sort_by("key")
    long = spark.sparkContext.broadcast(tuple(long[c].to_numpy() for c in ("key", "pt", "pe")))
    rounds = max(int(-(-moved * size // (frequent.n * max(MOVED * size, ROOM)))), 1)
    both = _filter(lists.select("key"), lists.count())

    def out(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        known, pt, pe = long.value
        for b in batches:
            rec, key = _asking(b, shared.value, cap, least)
            use = both.value.has(key)
            rec, key = rec[use], key[use]
            train, cls = (b.column(k).to_numpy(zero_copy_only=False)[rec] for k in (1, 0))
            parts = np.ones((2, len(key)), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                parts[:, hit] = pt[at[hit]], pe[at[hit]]
            i, other = _expand(np.where(train, parts[1], parts[0]))
            own = (cls.view(np.uint64) % np.where(train, parts[0], parts[1]).astype(np.uint64)).astype(np.int64)[i]
            cell = np.where(train[i], (own << 32) + other, (other << 32) + own).view(np.uint64)
            cell = kernel.mix(kernel.mix(key[i].view(np.uint64)) ^ cell)
            rec = rec[i]
            here = cell % np.uint64(rounds) == turn
            cell, rec = cell[here], rec[here]
            bucket = (kernel.mix(cell) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((rec, bucket))
            cell, rec, bucket = cell[order].view(np.int64), rec[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(rec) != 0) | (np.diff(bucket) != 0)])) if len(rec) else order
            ends = pa.array(np.append(first, len(rec)), pa.int32())
            docs = _within(b, _FIGURES).take(pa.array(rec[first])) if _by_figures(least) else b.take(pa.array(rec[first]))
            yield pa.RecordBatch.from_arrays([*docs.columns, pa.ListArray.from_arrays(ends, pa.array(cell))], ["cls", "train", "terms", "counts", "blocks", "gold", "cells"]), bucket[first].astype(np.int32)

    def send(turn: int):
        return lambda batches: _pack(out(batches, turn))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = list(_unpack(batches))
        if docs:
            docs = pa.Table.from_batches(docs).combine_chunks().to_batches()[0]
            for t, e in _meet(docs, shared.value, cap, least):
                yield pa.RecordBatch.from_arrays([docs.column(0).take(pa.array(t)), docs.column(0).take(pa.array(e))], ["cls_t", "cls_e"])

    done = []
    for turn in range(rounds):
        packed = rows.mapInArrow(send(turn), "bucket int, blob binary")
        done.append(durable(packed.repartitionById(buckets, "bucket").mapInArrow(receive, "cls_t long, cls_e long"), "candidates", tidy=True))
    discard(lists)
    found = done[0]
    for x in done[1:]:
        found = found.unionAll(x)
    pairs = durable(found.distinct(), "candidates", tidy=True)
    for x in done:
        discard(x)
    return pairs


class Bits:
    """A set of hashes as bits: ``has`` is never wrong where it says no."""

    def __init__(self, size: int):
        self.bits = np.zeros(size // 8, np.uint8)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return kernel.mix(key.view(np.uint64)) % np.uint64(8 * len(self.bits))

    def has(self, key: np.ndarray) -> np.ndarray:
        at = self._at(key)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _having(rows: DataFrame, wanted) -> DataFrame:
    """Rows whose first column is in a set of ``_filter``, and few others."""
    return rows.mapInArrow(lambda batches: (b.filter(pa.array(wanted.value.has(b.column(0).to_numpy()))) for b in batches), rows.schema)


def _filter(hashes: DataFrame, n: int):
    """A broadcast set of about ``n`` hashes, of at most 16 MB; built from the bits of each task, so the hashes don't come to the driver."""
    size = 1 << min(max(int(n * 8).bit_length(), 10), 27)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bits(size)
        for b in batches:
            at = np.unique(own._at(b.column(0).to_numpy()))
            np.bitwise_or.at(own.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        step = 1 << 16
        for k in range(0, len(own.bits), step):
            if own.bits[k : k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.bits[k : k + step].tobytes()], pa.binary())], ["at", "part"])

    def joined(rows: pa.Table) -> pa.Table:
        part = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in rows["part"].combine_chunks()])
        return pa.table({"at": rows["at"].slice(0, 1).cast(pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    whole = Bits(size)
    for row in hashes.coalesce(16).mapInArrow(bits, "at int, part binary").groupBy("at").applyInArrow(joined, "at int, part binary").toArrow().to_pylist():
        whole.bits[row["at"] : row["at"] + len(row["part"])] = np.frombuffer(row["part"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole)


def _within(b: pa.RecordBatch, first: int) -> pa.RecordBatch:
    """A batch of ``cls``, ``train``, ``terms``, ``counts``, ``blocks`` and more, with the terms of the blocks from ``first`` on only."""
    blocks, rec = _lists(b.column(4))
    use = np.flatnonzero(blocks >= first)
    ends = pa.array(np.searchsorted(rec[use], np.arange(b.num_rows + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, b.column(k).flatten().take(pa.array(use))) for k in (2, 3, 4)]
    return pa.RecordBatch.from_arrays([*b.columns[:2], *lists, *b.columns[5:]], b.schema.names)


def _meet(docs: pa.RecordBatch, table: Frequent, cap: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``docs`` (train, held) that share a list and may reach ``least``: by the prefixes of the context, the answers, the question, then by all terms here."""
    terms, rec = _lists(docs.column(2))
    counts, blocks = (_lists(docs.column(k))[0] for k in (3, 4))
    train, gold = (docs.column(k).to_numpy(zero_copy_only=False) for k in (1, 5))
    every, use = (terms, rec, counts, blocks), blocks >= IN_CONTEXT
    asked, here = tuple(x[use] for x in every), SHARES[:IN_CONTEXT].sum()
    if _by_figures(least):
        use = blocks == _FIGURES
        b = Bounds(terms[use], rec[use], counts[use], blocks[use], train, docs.num_rows, table, cap)
        said, rest = _prefix(b, _FIGURES, (least - (1 - SHARES[_FIGURES])) / SHARES[_FIGURES])
        words = here - SHARES[_FIGURES]  # of the context, granted in full
        rest += words
    else:
        b = Bounds(terms, rec, counts, blocks, train, docs.num_rows, table, cap)
        (said, _, rest), words = b.prefixes(table, least), 0.0
        there = np.where(np.where(train[b.rec], b.ne, b.nt) > 0, b.w, 0.0)
        whole = np.bincount(b.rec * len(BLOCKS) + b.blocks, there * there, minlength=b.n * len(BLOCKS)).reshape(b.n, len(BLOCKS))
        rest = rest - np.minimum(np.sqrt(SHARES * whole), SHARES)[:, IN_CONTEXT:].sum(1)
    cells, of = _lists(docs.column(6))
    n = np.bincount(b.rec[said], minlength=b.n)
    row, k = _expand(n[of])  # a row is a record in a list; its postings are the terms of its prefix
    post = said[(np.cumsum(n) - n)[of[row]] + k]
    key = kernel.mix(kernel.mix(b.terms[post].view(np.uint64)) ^ cells[row].view(np.uint64))
    side = train[of[row]]
    t, e = np.flatnonzero(side), np.flatnonzero(~side)
    e = e[np.argsort(key[e], kind="stable")]
    low, high = (np.searchsorted(key[e], key[t], x) for x in ("left", "right"))
    t, low, high = t[high > low], low[high > low], high[high > low]
    total, rows, begin = np.cumsum(high - low), row[t], 0
    while begin < len(t):
        # All postings of one row are in one piece, as its products are summed there.
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right"))
        if end < len(t):
            cut = int(np.searchsorted(rows, rows[max(end, begin)], "left"))
            end = cut if cut > begin else int(np.searchsorted(rows, rows[begin], "right"))
        i, j = _expand((high - low)[begin:end])
        x, y = t[begin:end][i], e[low[begin:end][i] + j]
        pair, at = np.unique(row[x] * np.int64(len(of)) + row[y], return_inverse=True)
        bound = np.bincount(at, b.w[post[x]] * b.w[post[y]], minlength=len(pair))
        x, y = of[pair // len(of)], of[pair % len(of)]
        bound = np.minimum(bound + np.maximum(rest[x], rest[y]), here)
        apart = np.abs(gold[x] - gold[y]) > 0.001 * np.abs(gold[y]) + 1.1e-5
        use = (bound + SHARES[IN_CONTEXT:].sum() >= least - 1e-6) & ~apart
        x, y, bound = x[use], y[use], bound[use]
        for lists, more in ((asked, bound), (every, words)):
            if len(x):
                use = more + _products(lists, train, table, cap, x, y) >= least - 1e-6
                x, y = x[use], y[use]
        if len(x):
            pair = np.unique(x * np.int64(b.n) + y)
            yield pair // b.n, pair % b.n
        begin = end


def _products(lists: list[np.ndarray], train: np.ndarray, table: Frequent, cap: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bounds on what the given terms (``terms``, ``rec``, ``counts``, ``blocks``) add to the cosine of records ``x`` and ``y``."""
    own, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    begin = np.searchsorted(lists[1], own)
    rec, k = _expand(np.searchsorted(lists[1], own, "right") - begin)
    terms, _, counts, blocks = (v[begin[rec] + k] for v in lists)
    b = Bounds(terms, rec, counts, blocks, train[own], len(own), table, cap)

    def key(at: np.ndarray, rec: np.ndarray) -> np.ndarray:
        return kernel.mix(b.terms[at].view(np.uint64) ^ kernel.mix(rec.astype(np.uint64) + np.uint64(1)))

    known = key(np.arange(len(b.rec)), b.rec)
    order = np.argsort(known)
    known, w = known[order], b.w[order]
    begin = np.searchsorted(b.rec, np.arange(b.n + 1))
    i, j = _expand(np.diff(begin)[x])
    at = begin[x[i]] + j
    wanted = key(at, y[i])
    where = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    product = np.where(known[where] == wanted, w[where] * b.w[at], 0.0)
    by_block = np.bincount(i * len(BLOCKS) + b.blocks[at], product, minlength=len(x) * len(BLOCKS)).reshape(len(x), len(BLOCKS))
    return np.minimum(by_block, SHARES).sum(1)


def _exact(pairs: DataFrame) -> DataFrame:
    """Adds the exact ``cosine`` of the two vectors of each candidate; where ``same`` is null, the figures of one side must all be on the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[_lists(b.column(k + side))[0] for side in (0, 3)] for k in (3, 4, 5)]
            owner = [_lists(b.column(k))[1] for k in (3, 6)]
            rec, terms, w, blocks = (np.concatenate(x) for x in (owner, *sides))
            figures = [np.bincount(r[x == _FIGURES], minlength=b.num_rows) for r, x in zip(owner, sides[2])]
            order = np.lexsort((terms, rec))
            rec, terms, w, blocks = rec[order], terms[order], w[order], blocks[order]
            both = np.flatnonzero((rec[1:] == rec[:-1]) & (terms[1:] == terms[:-1])) if len(rec) else order
            cosine = np.bincount(rec[both], w[both] * w[both + 1], minlength=b.num_rows)
            shared = np.bincount(rec[both[blocks[both] == _FIGURES]], minlength=b.num_rows)
            known = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            cosine = np.where(known | (shared == np.minimum(*figures)), cosine, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosine, pa.float64())], ["cls_t", "cls_e", "cosine"])

    return pairs.mapInArrow(run, "cls_t long, cls_e long, cosine double")


def class_pairs(examples: DataFrame, least: float = MIN_COSINE, cap: int = FREQUENT, eval_splits: tuple[str, ...] = EVAL_SPLITS) -> tuple[DataFrame, DataFrame]:
    """The overlapping classes of records (``cls_t``, ``cls_e``, ``cosine``), and the records of each class (``id``, ``split``, ``gold_source``, ``cls``).

    A class holds the records of one side whose terms and answer are the same, so a record copied into a third of the table is
    joined once. Every pair of classes with a cosine of ``least`` is found, see ``keys`` and ``_meet``. Only classes of a
    candidate get exact weights, so no vectors of the whole table are ever written or moved.
    """
    records = durable(_records(examples, eval_splits), "records", tidy=True)
    reps = records.where(F.col("terms").isNotNull()).select("cls", "train", "gold", "terms", "counts", "blocks")
    df, frequent = _counted(reps, cap)
    size = int(str(records._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cand = _candidates(reps, size, frequent, cap, least)
    wanted = cand.select(F.col("cls_t").alias("cls")).union(cand.select("cls_e")).distinct()
    some = durable(_having(reps, _filter(wanted, 2 * cand.count())).join(wanted, "cls", "left_semi"), "classes", tidy=True)
    vectors = durable(_weighted(some, df, frequent, cap), "vectors", tidy=True)
    members = durable(records.select("id", "split", "gold_source", "cls"), "members", tidy=True)
    for done in (records, some, df):
        discard(done)
    left, right = (vectors.select(F.col("cls").alias(f"cls_{x}"), *[F.col(f).alias(f"{f}_{x}") for f in ("gold", "terms", "w", "blocks")]) for x in ("t", "e"))
    both = cand.join(left, "cls_t").join(right, "cls_e")
    # Exact check: answers that can both be read must not contradict, as those of a ratio and its inverse do; otherwise figures are compared.
    close = F.abs(F.col("gold_t") - F.col("gold_e")) <= F.lit(0.001) * F.abs(F.col("gold_e")) + F.lit(1e-5)
    both = both.withColumn("same", close).where(F.coalesce("same", F.lit(True))).select("cls_t", "cls_e", "same", *[f"{f}_{x}" for x in ("t", "e") for f in ("terms", "w", "blocks")])
    return _exact(both).where(F.col("cosine") >= least), members


def overlaps(examples: DataFrame, least: float = MIN_COSINE, cap: int = FREQUENT, eval_splits: tuple[str, ...] = EVAL_SPLITS) -> DataFrame:
    """Every pair of a train record and a record of an evaluation split that ask the same of the same context with the same figures.

    Columns: ``train_id``, ``eval_id``, ``split`` and ``gold_source`` (of the evaluation record), ``cosine``. Records without
    id or of other splits are left out; null questions and contexts count as empty; repeated rows of one id give the pair once (the greatest cosine); an empty table gives none. The expansion of
    classes to records belongs to this form; ``class_pairs`` has the links between classes and the members.
    """
    pairs, members = class_pairs(examples, least, cap, eval_splits)
    t = members.where(F.col("split") == "train").select(F.col("cls").alias("cls_t"), F.col("id").alias("train_id"))
    e = members.where(F.col("split") != "train").select(F.col("cls").alias("cls_e"), F.col("id").alias("eval_id"), "split", "gold_source")
    rows = pairs.join(t.distinct(), "cls_t").join(e.distinct(), "cls_e")
    return rows.groupBy("train_id", "eval_id", "split", "gold_source").agg(F.max("cosine").alias("cosine"))


def overlap_counts(examples: DataFrame, **how) -> DataFrame:
    """Per split and source of the evaluation record: pairs, and evaluation and train records touched.

    Counted from the sizes of the classes, so no pair of records is built. An id that repeats with other texts counts in each of its classes.
    """
    pairs, members = class_pairs(examples, **how)
    pairs, members = durable(pairs.select("cls_t", "cls_e"), "class-pairs"), members.distinct()
    t = members.where(F.col("split") == "train").groupBy(F.col("cls").alias("cls_t")).agg(F.count_distinct("id").alias("nt"))
    e = members.where(F.col("split") != "train").groupBy(F.col("cls").alias("cls_e"), "split", "gold_source").agg(F.count_distinct("id").alias("ne"))
    source = F.coalesce("gold_source", F.lit("\0"))  # null sources form one group
    rows = pairs.join(t, "cls_t").join(e.withColumn("gold_source", source), "cls_e")
    key = ["split", "gold_source"]
    n_pairs = rows.groupBy(*key).agg(F.sum(F.col("nt") * F.col("ne")).alias("n_pairs"))
    n_eval = rows.select(*key, "cls_e", "ne").distinct().groupBy(*key).agg(F.sum("ne").alias("n_eval"))
    n_train = rows.select(*key, "cls_t", "nt").distinct().groupBy(*key).agg(F.sum("nt").alias("n_train"))
    return n_pairs.join(n_eval, key).join(n_train, key).withColumn("gold_source", F.nullif("gold_source", F.lit("\0")))
