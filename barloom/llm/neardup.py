"""Near-duplicate documents by Order MinHash, verified by banded alignment."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import Scratch

from .common import as_bytes, byte_words, free_name
from .components import components

#: Words of a k-mer; k-mers of a sketch (kept in text order); sketches of a text.
WORDS, KEPT, SKETCHES = 5, 2, 48
#: Edit similarity from which two texts are near duplicates.
SIMILAR = 0.8
#: When a round of comparisons adds less than this share of all links, what is still untested is compared pair by pair.
CONVERGED = 0.005
#: Members of buckets of up to so many untested ones meet in their bucket, those of larger ones block by block.
FEW = 32
#: A length class has up to ``PARTS`` blocks of ``PART`` texts, and more only where their bitmaps take over ``BLOCK_BYTES`` each.
PART, PARTS, BLOCK_BYTES = 1024, 8, 4 << 20
#: Bits of a bitmap for each word of the longest text of a length class, at least.
SPREAD = 4
CHUNK = 4096
#: Bits of a text's bitmap, which tells texts apart before they are fetched.
BITS = 512
# Odd multipliers for mixing 64-bit numbers.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordNumbers(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def kmers(numbers: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words, each mixed with its occurrence number; a shorter text is one k-mer."""
    k = min(words, len(numbers))
    if not k:
        return np.empty(0, np.uint64)
    h = np.zeros(len(numbers) - k + 1, np.uint64)
    for i in range(k):
        h = (h + numbers[i:len(numbers) - k + 1 + i]) * MIX[0]
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        place = np.arange(len(h))
        occurrence = np.empty(len(h), np.uint64)
        occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        h = h + occurrence * MIX[2]
    return mixed(h)


def order_sketches(h: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """A signature for each sketch: of its ``kept`` smallest k-mers, taken in the order in which they stand in the text."""
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * MIX[0])[:, None]
    best = np.full((sketches, 0), 0, np.uint64)
    where = np.full((sketches, 0), 0, np.int64)
    for a in range(0, len(h), CHUNK):
        x = (h[a:a + CHUNK][None, :] ^ seeds) * MIX[1]
        x ^= x >> np.uint64(32)
        x *= MIX[2]
        n = min(kept, x.shape[1])
        at = np.empty((sketches, n), np.int64)
        value = np.empty((sketches, n), np.uint64)
        rows = np.arange(sketches)
        for i in range(n):
            at[:, i] = x.argmin(axis=1)
            value[:, i] = x[rows, at[:, i]]
            x[rows, at[:, i]] = np.uint64(2**64 - 1)
        best, where = np.concatenate([best, value], axis=1), np.concatenate([where, at + a], axis=1)
        keep = np.argsort(best, axis=1, kind="stable")[:, :kept]
        best, where = np.take_along_axis(best, keep, axis=1), np.take_along_axis(where, keep, axis=1)
    out = seeds[:, 0].copy()
    for i, column in enumerate(np.sort(where, axis=1).T):
        out = mixed((out + h[column]) * MIX[0] + np.uint64(i))
    return out.view(np.int64)


def common_subsequence(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence that stays within ``band`` of the diagonal (in steps of a band's width).

    Bit-parallel: a row of the alignment is one whole number, whose zero bits mark where the length grows.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not a or not b:
        return head + tail
    step, low, row, done = max(256, band), 0, 0, 0
    high = 0
    for j in range(0, len(b), step):
        new_low, new_high = min(len(a), max(0, j - band)), min(len(a), j + step + band)
        gone = min(new_low, high) - low
        done += gone - (row & ((1 << gone) - 1)).bit_count()
        row = (row >> gone) | (((1 << (new_high - max(high, new_low))) - 1) << (max(high, new_low) - new_low))
        low, high = new_low, max(high, new_high)
        places: dict = {}
        for i in range(low, high):
            places[a[i]] = places.get(a[i], 0) | 1 << (i - low)
        full = (1 << (high - low)) - 1
        for c in b[j:j + step]:
            hit = row & places.get(c, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
    return head + tail + done + (high - low) - row.bit_count()


def edit_similarity(a: list, b: list, least: float = SIMILAR) -> float:
    """2 * common / (words of both): 1 less the share of words to insert and delete. Exact from ``least``; below, some lower number."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total or 2 * (Counter(a) & Counter(b)).total() < least * total:
        return 0.0
    return 2 * common_subsequence(a, b, int((1 - least) * total) + 1) / total


SKETCHED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("words", T.LongType()), T.StructField("marks", T.ArrayType(T.LongType()))])


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and two 64-bit hashes that tell texts apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text", F.octet_length("text")).alias("k2"))


def sketched(docs: DataFrame) -> DataFrame:
    """Every row's keys and order sketches; no text leaves the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            counts, marks = [], []
            for text in as_bytes(batch.column(1)):
                words = byte_words(text)
                h = kmers(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)))
                counts.append(len(words))
                marks.append(order_sketches(h) if len(h) else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(marks) if marks else [], pa.int64()))], names=SKETCHED.names)
    return keyed(docs).filter("text is not null").mapInArrow(run, SKETCHED)


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` (with texts ``text_a, text_b``) of at least this edit similarity."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [edit_similarity(byte_words(x), byte_words(y), least) >= least for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], names=out.names)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, out)


def named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with a ``node`` and its component's label, at first itself."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def joined_labels(links: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Labels after new links: components are computed over the labels that the links join, not over all links again."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = named(ends, labels)
    if labels is not None:
        now = now.unionByName(labels.join(ends, "node", "left_anti"))
    now = scratch.keep(now.select("node", "label"))
    of = lambda c, name: now.select(F.col("node").alias(c), F.col("label").alias(name))
    edges = links.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = components(edges, scratch).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return scratch.keep(now.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def fits(least: float) -> F.Column:
    """Whether the lengths ``words`` and ``other_words`` allow a similarity of ``least``."""
    return 2 * F.least("words", "other_words") >= least * (F.col("words") + F.col("other_words"))


def untested(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets that still hold several components, with ``size``, the number of the bucket's members."""
    members = named(live, labels)
    sizes = members.groupBy("mark").agg(F.count(F.lit(1)).alias("size"), (F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("mark", "size")
    return members.join(sizes, "mark")


def bitmap(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bitmaps(texts: DataFrame) -> DataFrame:
    """``node, b0, b1, ...``: a bit for every hash value of a text's words with their occurrence numbers, set if an odd number of them has it.

    A bit in which two texts differ stands for at least one word that they do not share.
    """
    names = [f"b{i}" for i in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            found = np.zeros((batch.num_rows, BITS // 64), np.int64)
            for i, text in enumerate(as_bytes(batch.column(1))):
                words = byte_words(text)
                found[i] = bitmap(kmers(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(found.shape[1]))], names=["node", *names])

    return texts.select("node", "text").mapInArrow(run, "node bigint, " + ", ".join(f"{n} bigint" for n in names))


def may_match(least: float) -> F.Column:
    """Whether lengths and bitmaps (those of the other side begin with ``o``) allow a similarity of ``least``: 1 - least of all words may not be shared."""
    apart = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o{i}"))) for i in range(BITS // 64)), F.lit(0))
    return fits(least) & (apart <= (1 - least) * (F.col("words") + F.col("other_words")) + 1e-6)


def other_side(rows: DataFrame, *keys: str | F.Column) -> DataFrame:
    return rows.select(*keys, F.col("node").alias("other"), F.col("label").alias("other_label"), F.col("words").alias("other_words"), *[F.col(f"b{i}").alias(f"o{i}") for i in range(BITS // 64)])


def small_pairs(members: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` within the buckets of ``members`` that are in different components and may be similar."""
    own = scratch.keep(bitmaps(texts.join(members.select("node").distinct(), "node")))
    rows = members.select("mark", "node", "label", "words").join(own, "node")
    met = rows.join(other_side(rows, "mark"), "mark").filter("node < other and label <> other_label").filter(may_match(least))
    return met.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def length_classes(least: float, most: int) -> np.ndarray:
    """First lengths of classes up to ``most`` words: lengths that allow a similarity of ``least`` are in one class or in neighbouring ones."""
    starts = [0]
    while starts[-1] <= most:
        starts.append(int(starts[-1] * ((2 - least) / least + 1e-9)) + 1)
    return np.array(starts, np.int64)


def class_bitmaps(texts: DataFrame, starts: np.ndarray) -> DataFrame:
    """``node, label, words, length_class, bits`` of ``node, text, label, words``: bitmaps as of ``bitmaps``, with more bits for longer texts.

    The bits of a class are a power of two, so that the bitmap of the longer class is folded onto the other's.
    """
    bits = [1 << max(6, (SPREAD * int(n) - 1).bit_length()) for n in starts[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            of = np.searchsorted(starts, batch.column(3).to_numpy(), "right") - 1
            found = []
            for c, text in zip(of.tolist(), as_bytes(batch.column(1))):
                words = byte_words(text)
                found.append(bitmap(kmers(np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words)), 1), bits[c]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(of, pa.int32()), pa.array(found, pa.binary())], names=["node", "label", "words", "length_class", "bits"])

    return texts.select("node", "text", "label", "words").mapInArrow(run, "node bigint, label bigint, words bigint, length_class int, bits binary")


def packed_blocks(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """A row for each block of ``class_bitmaps``: its texts in order of length, ``count`` of them, their columns as bytes."""
    of = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("length_class"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("words", "ascending"), ("node", "ascending")])
        whole = [table[n].to_numpy().tobytes() for n in ("node", "label", "words")]
        return pa.table([[table["length_class"][0].as_py()], [table["part"][0].as_py()], *[[x] for x in whole], [b"".join(table["bits"].to_pylist())]], schema=schema)

    schema = pa.schema([("length_class", pa.int32()), ("part", pa.int32()), *((n, pa.binary()) for n in ("node", "label", "words", "bits"))])
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), of).cast("int"))
    return dealt.groupBy("length_class", "part").applyInArrow(run, "length_class int, part int, node binary, label binary, words binary, bits binary")


def met_blocks(blocks: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``blocks`` once for every cell ``low, i, high, j`` of two blocks that may hold similar texts, those of one class or of neighbouring ones."""
    names = ["length_class", "part", "node", "label", "words", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                c, i = block.column(0)[0].as_py(), block.column(1)[0].as_py()
                cells = [(c, min(i, j), c, max(i, j)) for j in range(parts[c])]
                cells += [(c, i, c + 1, j) for j in range(parts.get(c + 1, 0))] + [(c - 1, j, c, i) for j in range(parts.get(c - 1, 0))]
                for cell in cells:
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in cell), *block.columns], names=["low", "i", "high", "j", *names])

    return blocks.select(*names).mapInArrow(run, "low int, i int, high int, j int, length_class int, part int, node binary, label binary, words binary, bits binary")


def block_pairs(low: dict, high: dict, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of two blocks (or of one with itself) in different components whose lengths and bitmaps allow the similarity."""
    same = low is high
    a, b = low["bits"], high["bits"]
    while b.shape[0] > a.shape[0]:
        b = b[:b.shape[0] // 2] ^ b[b.shape[0] // 2:]
    first = np.searchsorted(high["words"], low["words"] * (least / (2 - least)) - 1, "left")
    last = np.searchsorted(high["words"], low["words"] * ((2 - least) / least) + 1, "right")
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k, (start, end) in enumerate(zip(first.tolist(), last.tolist())):
        start = max(start, k + 1) if same else start
        if start >= end:
            continue
        apart = np.bitwise_count(b[:, start:end] ^ a[:, k:k + 1]).sum(axis=0, dtype=np.int64)
        both, short = low["words"][k] + high["words"][start:end], np.minimum(low["words"][k], high["words"][start:end])
        good = (apart <= (1 - least) * both + 1e-6) & (2 * short >= least * both) & (high["label"][start:end] != low["label"][k])
        if good.any():
            other = high["node"][start:end][good]
            found.append((np.full(len(other), low["node"][k]), other))
    one, two = (np.concatenate(x) for x in zip(*found))
    return np.minimum(one, two), np.maximum(one, two)


def hot_pairs(members: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` of ``members`` in different components whose lengths and bitmaps allow a similarity of ``least``.

    Texts are dealt to classes of lengths, their bitmaps packed in blocks, and a block meets those of its own class and of the next one, each pair of
    texts once. What is written grows with the texts and the pairs that may match; what is sent is a bitmap (4 to 12 bits a word, 64 at least) for each block
    that a text's block meets. Comparisons of bitmaps grow with the square of the texts of a class, spread over the cells of blocks.
    """
    nodes = members.select("node", F.col("label").cast("bigint").alias("label"), F.col("words").cast("bigint").alias("words")).distinct()
    starts = length_classes(least, nodes.agg(F.max("words")).first()[0] or 0)
    rows = scratch.keep(class_bitmaps(texts.join(nodes, "node"), starts))
    sizes = rows.groupBy("length_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bits") + 24).alias("size")).collect()
    parts = {r["length_class"]: max(min(PARTS, -(-r["n"] // PART)), -(-r["size"] // BLOCK_BYTES)) for r in sizes}
    cells = met_blocks(scratch.keep(packed_blocks(rows, parts)), parts) if parts else None
    if cells is None:
        return scratch.keep(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))

    def run(table: pa.Table) -> pa.Table:
        blocks = []
        for row in table.sort_by([("length_class", "ascending"), ("part", "ascending")]).select(["node", "label", "words", "bits"]).to_pylist():
            block = {n: np.frombuffer(row[n], np.int64) for n in ("node", "label", "words")}
            blocks.append(block | {"bits": np.ascontiguousarray(np.frombuffer(row["bits"], np.uint64).reshape(len(block["node"]), -1).T)})
        own = table["low"][0] == table["high"][0] and table["i"][0] == table["j"][0]
        if not own and len(blocks) < 2:  # no text was dealt to the other block
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        pairs = block_pairs(blocks[0], blocks[0 if own else 1], least)
        return pa.table([pa.array(x, pa.int64()) for x in pairs], names=["a", "b"])

    return scratch.keep(cells.groupBy("low", "i", "high", "j").applyInArrow(run, "a bigint, b bigint"))


def near_classes(docs: DataFrame, scratch: Scratch, least: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, class_docs, k1, k2`` (the last two: keys of the text) of every row; ``class_id`` is the smallest id of its class.

    Rows of equal text are one node. Nodes whose sketches agree somewhere are candidates: in every bucket, all members are compared
    with one chosen member, and linked from the given edit similarity of their words (see ``edit_similarity``). The chosen member, then
    tested, leaves its bucket. In buckets that still hold several components, all members then meet another one, chosen anew by a hash, until a
    round adds less than ``CONVERGED`` of the links. What is then untested in different components is compared pair by pair: in buckets of
    ``FEW`` members by bucket, members of larger ones block by block (``hot_pairs``), and of these the pairs whose lengths and bitmaps allow
    the similarity (``bitmaps``; they lose none) on their texts. So no candidate pair of different components is left. Classes are the components
    of all links.

    Words: runs of ASCII letters and digits and all other characters beyond ASCII, ASCII letters in lower case. Null texts are classes of their own; texts
    without words are linked to equal texts only. Rows with equal ids and different texts are told apart by text. Null ids are kept;
    a class of such rows alone has a null class_id. An empty table gives no rows. Other columns are not read.
    """
    rows = scratch.keep(sketched(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")))
    nodes = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("marks").alias("marks"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    spread = nodes.select("node", "words", F.explode("marks").alias("mark"))
    shared = spread.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    live = scratch.keep(spread.join(shared, "mark"))
    needed = nodes.select("node", "k1", "k2", "first_id").join(live.select("node").distinct(), "node")
    texts = keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).join(needed, ["k1", "k2"]).filter("doc_id <=> first_id")
    texts = scratch.keep(texts.groupBy("node").agg(F.first("text").alias("text")))

    def link(pairs: DataFrame, labels: DataFrame | None) -> tuple[int, DataFrame | None]:
        found = scratch.keep(verified(with_texts(pairs, texts), least))
        new = found.count()
        return new, joined_labels(found, labels, scratch) if new else labels

    links, labels, turn = 0, None, 0
    while True:
        members = named(live, labels)
        place = F.col("node") if turn == 0 else F.xxhash64("node", "mark", F.lit(turn))
        chosen = members.groupBy("mark").agg(F.min(F.struct(place.alias("place"), "node", "label", "words")).alias("c")).select("mark", F.col("c.node").alias("other"), F.col("c.label").alias("other_label"), F.col("c.words").alias("other_words"))
        met = members.join(chosen, "mark").filter("label <> other_label").filter(fits(least))
        new, labels = link(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), labels)
        links += new
        # The chosen member has met all others of its bucket; without it, a bucket of two holds no pair.
        state = named(live, labels).groupBy("mark").agg((F.min("label") != F.max("label")).alias("mixed"), F.count(F.lit(1)).alias("n"), F.min(F.struct(place.alias("place"), "node")).alias("c"))
        open_marks = state.filter("mixed and n > 2").select("mark", F.col("c.node").alias("tested"))
        before, live = live, scratch.keep(live.join(open_marks, "mark").filter("node <> tested").drop("tested"))
        scratch.drop(before)
        if new <= CONVERGED * links and turn or not links or live.isEmpty():
            break
        turn += 1
    few = untested(live, labels).filter(F.col("size") <= FEW)
    if not few.isEmpty():
        labels = link(small_pairs(few, texts, least, scratch), labels)[1]
    hot = untested(live, labels).filter(F.col("size") > FEW)
    if not hot.isEmpty():
        labels = link(hot_pairs(hot, texts, least, scratch), labels)[1]
    scratch.drop(live)
    scratch.drop(texts)
    labelled = nodes.select("node", "k1", "k2", "first_id", "copies")
    labelled = named(labelled, labels)
    classes = labelled.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_docs"))
    by_text = scratch.keep(labelled.join(classes, "label").select("k1", "k2", "class_id", "class_docs"))
    known = rows.select("doc_id", "k1", "k2").join(by_text, ["k1", "k2"]).select("doc_id", "class_id", "class_docs", "k1", "k2")
    alone = docs.filter("text is null").select(F.col("doc_id").cast("bigint").alias("doc_id")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_docs"), F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"))
    return known.unionByName(alone)


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of every class, that with the smallest id, and all documents with null texts, with their own columns.

    Rows equal in id and text count as one. Nulls compare as equal.
    """
    classes = scratch.keep(near_classes(docs, scratch))
    gone = classes.filter("not (doc_id <=> class_id)").select("doc_id", "k1", "k2").distinct()
    twice = classes.filter("doc_id <=> class_id and k1 is not null").groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    names, own = docs.columns, [free_name(docs, "own_key1"), free_name(docs, "own_key2")]
    with_keys = docs.withColumns({own[0]: F.xxhash64("text"), own[1]: F.xxhash64(F.lit("second"), "text", F.octet_length("text"))})
    same = lambda t: docs["doc_id"].cast("bigint").eqNullSafe(t["doc_id"]) & (F.col(own[0]) == t["k1"]) & (F.col(own[1]) == t["k2"])
    if twice.isEmpty():
        return with_keys.join(gone, same(gone), "left_anti").select(*names)
    both = scratch.keep(gone.unionByName(twice))
    once = with_keys.join(both, same(both), "left_anti")
    again = with_keys.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*names)
