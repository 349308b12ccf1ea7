"""N-gram Jaccard join: multiple-global-order prefix filtering, exact verification, components.

A token is the fingerprint of a shingle, so tokens have a global order of their own; tokens of many documents are moved
behind all others in it, which any global order may do. Two sets of Jaccard similarity t share a token among the first
|x| - ceil(t |x|) + 1 of each, under every order. The first order finds candidates, by families (see jaccard_components);
two more orders, over other fingerprints, must agree before two sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm import kernels as K
from riskgraph.llm.common import components, cut, drop_table, frugal, pick, row_key, shuffle_width
from riskgraph.llm.meet import FILTER_BITS, MOST_FILTER_BITS, filter_of, in_filter, key_array, key_words, meetings, met

#: Documents from which a token is common, and goes last in the first order.
COMMON = 4
#: Tokens below this come first in the first order, and of these alone the documents are counted.
COUNTED = np.uint64(1 << 63)
#: Tokens that a task holds before it hands them on.
HELD = 500_000
#: Pairs of parity maps compared at once.
MATRIX = 1 << 20
#: Changes of a token that make the other orders.
ORDERS = (np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5A1E38B93))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The ascending distinct tokens of each row: shingles of n words, A-Z lower-cased, or all words if they are fewer."""
    starts, ends, bounds = K.words(data, offsets)
    prints = K.span_prints(data, starts, ends, K.FOLDED)
    joined = prints.copy()
    for k in range(1, n):
        joined = joined[: max(0, len(prints) - k)] * np.uint64(0x9DDFEA08EB382D69) + prints[k:]
    joined = K.mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            tokens = np.sort(joined[a : b - n + 1])
            new = np.ones(len(tokens), bool)
            np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
            out.append(tokens[new])
        elif b > a:
            out.append(K.run_prints(K.prefix_sums(prints[a:b]), np.zeros(1, np.int64), np.full(1, b - a)))
        else:
            out.append(joined[:0])
    return out


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def set_key(tokens: np.ndarray) -> bytes:
    """A 128-bit key of a set; documents of one key are one class, of which the join sees one member."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def other_prefixes(tokens: np.ndarray, percent: int) -> list[np.ndarray]:
    """Under each other order the high halves of the prefix, ascending; a half can only admit a pair too many."""
    p = prefix_size(len(tokens), percent)
    out = []
    for change in ORDERS:
        order = K.mix(tokens ^ change)
        first = np.partition(order, p - 1)[:p] if p < len(order) else order
        out.append(np.sort((first >> np.uint64(32)).astype(np.uint32)))
    return out


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two prefixes under one order allow their sets to be similar: they share a token, and up to where the first of
    them ends, where both show all they have, no more tokens differ than similar sets differ in altogether."""
    both = np.intersect1d(x, y)
    if not len(both):
        return False
    end = min(x[-1], y[-1])
    differ = len(np.unique(x[x < end])) + len(np.unique(y[y < end])) - 2 * int((both < end).sum())
    # a prefix of p tokens is that of a set of at most p * 100 / (100 - percent), so this is no tighter than the sizes allow
    return differ * (100 + percent) <= (len(x) + len(y)) * 100


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """A bit for each residue of the tokens, set if an odd number of them has it; as many bits as tokens or more, 256 at least.

    Two maps differ in no more bits than their sets in tokens, so maps too far apart rule a pair out, exactly.
    """
    bits = max(256, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """The map as it would be with fewer bits."""
    while len(parity) > words:
        half = len(parity) // 2
        parity = parity[:half] ^ parity[half:]
    return parity


def near_pairs(sizes: np.ndarray, maps: list[np.ndarray], percent: int, block: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets (sizes ascend), likeliest first in each lot, whose sizes and parity maps allow their similarity, and how far
    the maps are apart; with block, pairs across blocks only."""
    widths = np.array([len(m) for m in maps])
    for words in np.unique(widths).tolist():
        low, high = np.searchsorted(widths, words), np.searchsorted(widths, words, "right")
        reach = int(np.searchsorted(sizes, sizes[high - 1] * 100 // percent, "right"))
        x = np.stack([folded(m, words) for m in maps[low:reach]])
        begin = 0
        while begin < high - low:
            end = min(high - low, begin + max(1, MATRIX // (reach - low - begin)))
            far = int(np.searchsorted(sizes, sizes[low + end - 1] * 100 // percent, "right")) - low
            apart = np.zeros((end - begin, far - begin), np.uint32)
            for k in range(words):
                apart += np.bitwise_count(x[begin:end, k, None] ^ x[None, begin:far, k])
            one, two = sizes[low + begin : low + end, None], sizes[None, low + begin : low + far]
            near = (apart * (100 + percent) <= (100 - percent) * (one + two)) & (one * 100 >= two * percent)
            near &= np.arange(begin, end)[:, None] < np.arange(begin, far)[None]
            if block is not None:
                near &= block[low + begin : low + end, None] != block[None, low + begin : low + far]
            p, q = np.nonzero(near)
            first = np.argsort(apart[p, q], kind="stable")
            yield p[first] + low + begin, q[first] + low + begin, apart[p, q][first]
            begin = end


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are similar."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def binary(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.BinaryType()) for n in names]


def longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def parted(parts: int, by: np.ndarray, ascending: np.ndarray, *rest: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Rows by part, in each of them sorted by the first column, as packed blobs."""
    part = (by % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((ascending, part))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in (ascending, *rest)]
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        mine = [c[bounds[p] : bounds[p + 1]] for c in columns]
        yield p, [K.pack_sorted(mine[0]), *(K.pack(c) for c in mine[1:])]


def common_tokens(texts: DataFrame, n: int, parts: int) -> np.ndarray:
    """A filter of the counted tokens of at least COMMON documents, or of still commoner ones if there are too many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, classes = [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, many = np.unique(np.concatenate(held), return_counts=True)
            rows = list(parted(parts, tokens, tokens, np.minimum(many, 2**32 - 1).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), *(pa.array([b[i] for _, b in rows], pa.binary()) for i in range(2))], names=["part", "tokens", "many"])

        for batch in batches:
            for _, _, data, offsets in K.pieces(batch.column(0)):
                for tokens in shingle_sets(data, offsets, n):
                    key = set_key(tokens)
                    if key in classes or not len(tokens):
                        continue
                    classes.add(key)
                    tokens = tokens[: np.searchsorted(tokens, COUNTED)]
                    held.append(tokens)
                    size += len(tokens)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([K.unpack_sorted(b) for b in frame["tokens"]])
        many = np.concatenate([K.unpack(b, np.uint32) for b in frame["many"]]).astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        tokens, many = tokens[order], many[order]
        head = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        sums = np.add.reduceat(many, head)
        return pd.DataFrame({"token": K.signed(tokens[head][sums >= COMMON]), "many": sums[sums >= COMMON]})

    counted = texts.mapInArrow(frugal(count), T.StructType([*longs("part"), *binary("tokens", "many")]))
    common = cut(counted.groupBy("part").applyInPandas(frugal(add_up), T.StructType(longs("token", "many"))))
    least = COMMON
    while common.where(F.col("many") >= least).count() * FILTER_BITS > MOST_FILTER_BITS:
        least *= 2
    words = filter_of(common.where(F.col("many") >= least).select(F.col("token").alias("member")))
    drop_table(common)
    return words


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of df.

    A row's set: the distinct shingles of n words of its text ([^\\x20\\x09-\\x0D]+, A-Z lower-cased), all its words as one
    shingle if they are fewer; no words or a null text: the empty set, which links with nothing. Rows link when
    100 * intersection >= percent * union. component_id: the least doc_id reachable by links, its own included; it is null
    only if all doc_ids reached are. Repeated rows stay, linked with each other; other columns are left out. An empty table
    gives an empty one.

    Equal sets are one class and are joined once. Classes that share a token of the first order's prefix are a group, and its
    least class names the family that all of them belong to, so the groups of a document's copies are few families. Within a
    family all members meet, first by size and parity map alone, then those with someone left to link with by the prefixes of
    the other orders and by their whole sets. No pair leaves a task but the links of a spanning forest.
    """
    source = pick(df, doc_id, text).toDF("doc_id", "text")
    spark, parts = df.sparkSession, shuffle_width(source)
    texts = source.select("text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents with their classes, and each class of the task with its parity map and the print of a text of it."""
        seen = set()
        for batch in batches:
            prints = batch.column(2).to_numpy()
            for first, last, data, offsets in K.pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                keys = [set_key(tokens) if len(tokens) else None for tokens in sets]
                lengths = pa.array([len(tokens) for tokens in sets], pa.int64())
                none = pa.nulls(len(sets))
                ids = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, lengths, pa.array(keys, pa.binary()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array([True] * len(sets))], names=schema.names)
                new = [i for i, key in enumerate(keys) if key and not (key in seen or seen.add(key))]
                # rows of classes carry some id, as a struct can't be null in all Arrow readers
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(new, pa.int32())), lengths.take(pa.array(new, pa.int32())), pa.array([keys[i] for i in new], pa.binary()), pa.array([parity_map(sets[i]).tobytes() for i in new], pa.binary()), pa.array(prints[first:last][new]), pa.array([False] * len(new))], names=schema.names)

    schema = T.StructType([source.schema["doc_id"], *longs("n_shingles"), *binary("class", "parity"), *longs("print"), T.StructField("is_doc", T.BooleanType())])
    described = cut(source.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(frugal(describe), schema), "is_doc")
    docs = described.where("is_doc").select("doc_id", "n_shingles", "class")
    classes = described.where("not is_doc").groupBy(F.col("class").alias("node")).agg(F.max(F.struct("n_shingles", "parity", "print")).alias("x"))
    classes = classes.select("node", F.col("x.n_shingles").alias("size"), "x.parity", "x.print")
    common = spark.sparkContext.broadcast(common_tokens(texts, n, parts))

    def first_order(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The prefix of each set: uncommon counted tokens, uncounted ones, common ones, each in ascending order."""
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        is_common = flat < COUNTED
        is_common[is_common] = in_filter(common.value, flat[is_common])
        begin = 0
        for tokens in sets:
            mine = is_common[begin : begin + len(tokens)]
            begin += len(tokens)
            p = prefix_size(len(tokens), percent)
            out = tokens[~mine][:p] if mine[: 2 * p].any() else tokens[:p]
            yield np.concatenate([out, tokens[mine][: p - len(out)]]) if len(out) < p else out

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The (token, class) of all prefixes by part; a class that a task meets again adds nothing."""
        held: list[tuple] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            token = np.concatenate([t for t, _ in held])
            keys = np.frombuffer(b"".join(k for _, k in held), np.uint64).reshape(-1, 2)
            rows = list(parted(parts, token, token, np.repeat(keys, [len(t) for t, _ in held], 0)))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), *(pa.array([b[i] for _, b in rows], pa.binary()) for i in range(2))], names=["part", "tokens", "keys"])

        for batch in batches:
            for _, _, data, offsets in K.pieces(batch.column(0)):
                sets = shingle_sets(data, offsets, n)
                for tokens, prefix in zip(sets, first_order(sets), strict=True):
                    key = set_key(tokens)
                    if len(tokens) and key not in seen:
                        seen.add(key)
                        held.append((prefix, key))
                        size += len(prefix)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    pair = T.StructType(binary("family", "node"))

    def families(table: pa.Table) -> pa.Table:
        """The members of the groups of a part's tokens, under the least of each group; groups of one member are left out."""
        token = np.concatenate([K.unpack_sorted(b) for b in table["tokens"].to_pylist()])
        key = np.concatenate([K.unpack(b, np.dtype("V16")).view(np.uint64).reshape(-1, 2) for b in table["keys"].to_pylist()])
        order = np.lexsort((key[:, 1], key[:, 0], token))
        token, key = token[order], key[order]
        new = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]).any(1))
        token, key = token[new], key[new]
        head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        many = np.diff(np.append(head, len(token)))
        both = np.hstack([np.repeat(key[head], many, 0), key])[np.repeat(many, many) > 1]
        both = both[np.lexsort(both.T)]
        both = both[np.append(True, (both[1:] != both[:-1]).any(1))] if len(both) else both
        return pa.Table.from_arrays([key_array(both[:, :2]), key_array(both[:, 2:])], names=pair.names)

    bundles = texts.mapInArrow(frugal(prefixes), T.StructType([*longs("part"), *binary("tokens", "keys")]))
    members = bundles.groupBy("part").applyInArrow(frugal(families), pair).distinct()
    members = cut(members.join(classes, "node").select("family", "node", "size", "parity"))

    def close(table: pa.Table) -> pa.Table:
        """The members that some other of their meeting may link with, as far as sizes and parity maps tell."""
        sizes = table["size"].to_numpy()
        maps = [np.frombuffer(b, np.uint64) for b in table["parity"].to_pylist()]
        some = np.zeros(len(sizes), bool)
        for rows, block in meetings(table, sizes):
            for p, q, _ in near_pairs(sizes[rows], [maps[k] for k in rows.tolist()], percent, block):
                some[rows[p]] = some[rows[q]] = True
        return table.select(pair.names).filter(pa.array(some))

    left = cut(met(members, F.length("parity")).groupBy("task").applyInArrow(frugal(close), pair).distinct())
    drop_table(members)
    needed = left.select("node").distinct().join(classes, "node").select(F.col("print").alias("member"))
    wanted = spark.sparkContext.broadcast(filter_of(needed))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the texts whose print is wanted; of any other the text is not even split."""
        seen = set()
        for batch in batches:
            some = in_filter(wanted.value, batch.column(1).to_numpy().view(np.uint64))
            for _, _, data, offsets in K.pieces(batch.column(0).filter(pa.array(some))):
                sets = {set_key(tokens): tokens for tokens in shingle_sets(data, offsets, n) if len(tokens)}
                new = [key for key in sets if key not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([K.pack_sorted(sets[k]) for k in new], pa.binary())], names=["node", "tokens"])

    sets = source.select("text", F.xxhash64("text").alias("print")).mapInArrow(frugal(fetch), T.StructType(binary("node", "tokens")))
    held = cut(left.join(sets.groupBy("node").agg(F.max("tokens").alias("tokens")), "node"))
    drop_table(left)

    def verify(table: pa.Table) -> pa.Table:
        """A spanning forest of the links among the members of each meeting; members already connected need no look."""
        nodes, packed = table["node"].to_pylist(), table["tokens"].to_pylist()
        sizes, links = np.array([len(b) // 8 for b in packed], np.int64), []
        for rows, block in meetings(table, sizes):
            tokens = [K.unpack_sorted(packed[k]) for k in rows.tolist()]
            first: dict[int, list[np.ndarray]] = {}
            tree = list(range(len(rows)))

            def root(a: int, tree: list[int] = tree) -> int:
                while tree[a] != a:
                    tree[a] = tree[tree[a]]
                    a = tree[a]
                return a

            for lot in near_pairs(sizes[rows], [parity_map(t) for t in tokens], percent, block):
                for p, q in zip(*(side.tolist() for side in lot[:2]), strict=True):
                    a, b = root(p), root(q)
                    if a == b:
                        continue
                    for side in (p, q):
                        if side not in first:
                            first[side] = other_prefixes(tokens[side], percent)
                    if all(may_link(x, y, percent) for x, y in zip(first[p], first[q], strict=True)) and linked(tokens[p], tokens[q], percent):
                        tree[max(a, b)] = min(a, b)
                        links.append((nodes[rows[p]], nodes[rows[q]]))
        return pa.Table.from_arrays([pa.array([x[s] for x in links], pa.binary()) for s in (0, 1)], names=["a", "b"])

    forest = met(held, F.length("tokens")).groupBy("task").applyInArrow(frugal(verify), T.StructType(binary("a", "b")))
    found = components(forest).withColumnRenamed("node", "class")
    drop_table(held)
    least = docs.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")).join(found, "class", "left")
    least = least.select("class", "least", F.coalesce("component", "class").alias("component"))
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "component_id")
    out = docs.join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, **options) -> DataFrame:
    """df (doc_id, text, lang, source, n_chars) with one row of each component, that of the least doc_id; of its twins one.

    A row without words is a component of its own. Null doc_ids come first; ties of one doc_id fall by a hash of the row.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = pick(df, *columns).withColumn("tag", row_key(*columns))
    found = jaccard_components(rows.select(F.struct("doc_id", "tag").alias("id"), "text"), doc_id="id", **options)
    stay = found.where("doc_id = component_id").select(F.col("doc_id.tag").alias("tag")).distinct()
    return rows.join(stay, "tag", "left_semi").dropDuplicates(["tag"]).select(*columns)
