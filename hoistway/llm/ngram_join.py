"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.75, and what they connect.

A set of n shingles can only link with sets with which it shares T = ceil(0.75 n) or more. The steps:

1. Texts with equal sets are one class (a 64-bit key over the set); only classes go on.
2. Sieve. In an order of all shingles by hash, two linked sets share at least l of their first n - T + l shingles. These meet by hash range, packed as
   arrays; classes of whose first shingles too few occur in another class are dropped. Shingles that several classes of one batch have are counted in place
   and shipped once, so a passage in a third of all texts costs one entry a batch.
3. Among the rest every shingle's document frequency is counted the same way, except for hot ones, which are found by batch counts and
   come last in the order. Rarest first, a set can only link with sets that share one of its n - T + 1 rarest shingles. Each such shingle joins
   the sets that have it to the least of them; connected components of this graph are the groups within which links can be.
4. T-occurrence search within groups, by DivideSkip: inverted lists of the query's shingles are parted into long and short; the short are merged by a heap, sets
   found often enough in them are looked up in the long ones by binary search, and those that reach the required overlap link. Groups larger than a
   block are cut into blocks: each is searched within itself and against a few leaders of its group. What is still apart in a large group can only link where it
   shares a rare shingle, so afterwards each list of sets behind such a shingle that holds several components (equal lists once) is searched, or the group as one
   list where that copies fewer sets: all but a list's largest component against its blocks. Sets that are connected already aren't compared again, so no link
   between components is missed and no group of copies is expanded into its pairs.
5. Connected components of the links; each document gets the least doc_id of its component.

Shingles are 64-bit hashes: two different ones of a corpus of 10**8 agree with a probability of 3 in 10,000.

Defined results: null, empty and wordless texts have 0 shingles and are their own component; rows that repeat a doc_id each get a row, by their own text; a row with a null
doc_id takes part like any other and gets its component's least id (null where no row of it has one). Texts of fewer than five words are one shingle. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_columns, stored
from .components import components
from .shingles import mixed, shingle_sets

#: 100 * intersection >= PERCENT * union links.
PERCENT = 75
#: Share of a set by which the sieve's part is longer than a prefix filter's; texts hashed at a time; shingles meant for a bucket.
EXTRA, BATCH, BUCKET_SHINGLES = 0.1, 500, 400_000
#: Sets of a block, leaders of a large group; sets whose ids are broadcast at most; a shingle in more than 1 / HOT of the sets is hot.
BLOCK, LEADERS, BROADCAST_SETS, HOT = 128, 6, 1_000_000, 500
#: Rows of groups or lists that are broadcast at most; beyond it they meet their members by key and salt.
BROADCAST_GROUPS, SALTS = 500_000, 64
#: The cost of probing against merging in DivideSkip's choice of long lists.
MU = 0.0085


def required(n):
    """The least overlap of a set of n shingles with any set it links with."""
    return -(-PERCENT * n // 100)


def set_key(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(mixed(shingles + np.uint64(0x9E37)).sum(dtype="u8", keepdims=True) + np.uint64(len(shingles)))[0].astype("i8"))


def _texts(df: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash, n_shingles, key (null for empty sets)."""

    def run(ids, hashes, texts):
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()])
        return {"doc": ids, "text_hash": hashes, "n_shingles": [len(s) for s in sets], "key": [set_key(s) if len(s) else None for s in sets]}

    t = _texts(docs, text_col)
    return map_columns(docs.select(F.col(id_col).alias("doc"), F.xxhash64(t).alias("h"), t.alias("t")), run, f"doc {docs.schema[id_col].dataType.simpleString()}, text_hash long, n_shingles long, key long", BATCH)


_PACKED = "bucket int, shingles binary, keys binary, local binary, done_keys binary, done_counts binary"


_ARROW = pa.schema([(name, pa.int32() if kind == "int" else pa.binary()) for name, kind in (c.split() for c in _PACKED.split(", "))])


def _ranges(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return ((shingles >> np.uint64(33)).astype("i8") * buckets) >> 31


def _pack(shingles, keys, local, done_keys, done_counts, buckets) -> Iterator[tuple]:
    """Rows for each bucket of hash ranges; what is counted already rides along with the first."""
    at = _ranges(shingles, buckets)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    rest = (done_keys.tobytes(), done_counts.astype("i4").tobytes())
    for b in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[b] : cuts[b + 1]]
        yield int(b), shingles[part].tobytes(), keys[part].tobytes(), local[part].astype("u1").tobytes(), *rest
        rest = (b"", b"")
    if rest[0]:
        yield 0, b"", b"", b"", *rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def sieve(docs: DataFrame, sizes: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """key, n of the classes that may link with another."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            parts, owners, seen = [], [], set()
            for lo in range(0, len(texts), BATCH):
                for s in shingle_sets(texts[lo : lo + BATCH]):
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)
                        parts.append(s[: len(s) - required(len(s)) + int(EXTRA * len(s)) + 1])
                        owners.append(key)
            if not parts:
                continue
            shingles, keys = np.concatenate(parts), np.repeat(np.array(owners, "i8"), [len(p) for p in parts])
            order = np.argsort(shingles, kind="stable")
            shingles, keys = shingles[order], keys[order]
            head = np.concatenate([[True], shingles[1:] != shingles[:-1]])
            count = np.diff(np.append(np.flatnonzero(head), len(shingles)))
            several = np.repeat(count > 1, count)
            done_keys, done_counts = np.unique(keys[several], return_counts=True)
            keep = head | ~several
            yield _batch(list(_pack(shingles[keep], keys[keep], several[keep], done_keys, done_counts, buckets)))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles, keys = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("shingles", "u8"), ("keys", "i8")))
        local = np.frombuffer(b"".join(pdf["local"]), "u1").astype(bool)
        order = np.lexsort((keys, shingles))
        shingles, keys, local = shingles[order], keys[order], local[order]
        new = np.ones(len(shingles), bool)
        new[1:] = shingles[1:] != shingles[:-1]
        run = np.cumsum(new) - 1
        other = np.ones(len(shingles), bool)
        other[1:] = new[1:] | (keys[1:] != keys[:-1])
        n = int(run[-1]) + 1 if len(run) else 0
        shared = (np.bincount(run, other, n) > 1) | (np.bincount(run, local, n) > 0)
        found = keys[other & ~local & shared[run]] if n else keys
        more, counts = np.unique(found, return_counts=True)
        done = [np.frombuffer(b"".join(pdf[c]), t) for c, t in (("done_keys", "i8"), ("done_counts", "i4"))]
        return pd.DataFrame({"key": np.concatenate([more, done[0]]), "shared": np.concatenate([counts, done[1]]).astype("i8")})

    packed = docs.select(_texts(docs, text_col).alias("t")).mapInArrow(ship, _PACKED)
    shared = packed.groupBy("bucket").applyInPandas(meet, "key long, shared long").groupBy("key").agg(F.sum("shared").alias("shared"))
    enough = F.floor(F.ceil(F.col("n") * PERCENT / 100) * EXTRA) + 1
    return shared.join(sizes, "key").where(F.col("shared") >= enough).select("key", "n")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, n, shingles (sorted, as bytes) of one document of each class in wanted (doc, or the hash of a text without one)."""
    t, doc = _texts(docs, text_col), F.col(id_col)
    rows = docs.select(doc.alias("doc"), F.when(doc.isNull(), F.xxhash64(t)).otherwise(0).alias("h"), t.alias("t")).alias("r")
    chosen = (F.broadcast(wanted) if wanted.count() <= BROADCAST_SETS else wanted).alias("w")
    rows = rows.join(chosen, F.col("r.doc").eqNullSafe(F.col("w.doc")) & (F.col("r.h") == F.col("w.h")), "left_semi").select("t")

    def run(texts):
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()])
        return {"key": [set_key(s) for s in sets], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    return map_columns(rows, run, "key long, n int, shingles binary", BATCH).where("n > 0").dropDuplicates(["key"])


def hot_shingles(sets: DataFrame, total: int) -> np.ndarray:
    """Shingles in more than 1 / HOT of the sets, as far as counts within batches show: at most HOT times a set's mean size, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, counts = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "u8"), return_counts=True)
                many = counts > max(2, batch.num_rows / HOT)
                yield pa.RecordBatch.from_arrays([pa.array(values[many].view("i8")), pa.array(counts[many].astype("i8"))], names=["s", "c"])

    least = max(64, total // HOT)
    rows = sets.select("shingles").mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") > least).select("s").collect()
    return np.sort(np.array([r[0] for r in rows], "i8").view("u8"))


def rarest_shingles(sets: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """key, s: of each set, the shingles one of which it shares with any set it links with, rarest first."""
    sent = sets.sparkSession.sparkContext.broadcast(hot)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column("key")).astype("i8")
            sizes = np.asarray(batch.column("n"))
            shingles, owners = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "u8"), np.repeat(keys, sizes)
            cold = ~np.isin(shingles, sent.value)
            yield _batch(list(_pack(shingles[cold], owners[cold], cold[cold], np.zeros(0, "i8"), np.zeros(0, "i4"), buckets)))

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles, keys = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("shingles", "u8"), ("keys", "i8")))
        _, run, count = np.unique(shingles, return_inverse=True, return_counts=True)
        df = count[run]
        several = df > 1
        keys, shingles, df = keys[several], shingles[several], df[several].astype("i4")
        order = np.argsort(keys, kind="stable")
        keys, shingles, df = keys[order], shingles[order], df[order]
        owners, first = np.unique(keys, return_index=True)
        cuts = [*first.tolist(), len(keys)]
        return pd.DataFrame({"key": owners, "s": [shingles[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], "df": [df[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]})

    shared = sets.mapInArrow(ship, _PACKED).groupBy("bucket").applyInPandas(frequencies, "key long, s binary, df binary")
    gathered = shared.groupBy("key").agg(F.collect_list(F.struct("s", "df")).alias("parts"))

    def rarest(keys, sizes, sets_, parts):
        out_key, out_s = [], []
        for key, n, own, rows in zip(keys.to_pylist(), sizes.to_pylist(), sets_.to_pylist(), parts.to_pylist()):
            own = np.frombuffer(own, "u8")
            rows = rows or []
            s = np.frombuffer(b"".join(r["s"] for r in rows), "u8")
            df = np.frombuffer(b"".join(r["df"] for r in rows), "i4")
            late = own[np.isin(own, sent.value)]
            alone = n - len(s) - len(late)
            take = n - required(n) + 1 - alone  # shingles that no other set has come first and lead nowhere
            if take > 0:
                first = np.concatenate([s[np.lexsort((s, df))], late])[:take]
                out_key += [key] * len(first)
                out_s += first.view("i8").tolist()
        return {"key": out_key, "s": out_s}

    return map_columns(sets.join(gathered, "key", "left").select("key", "n", "shingles", "parts"), rarest, "key long, s long", 200)


def prefix_edges(firsts: DataFrame) -> DataFrame:
    """a, b: keys of sets that share one of their rarest shingles, each with the least set that has it."""
    least = firsts.groupBy("s").agg(F.min("key").alias("b"), F.count("*").alias("c")).where("c > 1").select("s", "b")
    return firsts.join(least, "s").where("key <> b").select(F.col("key").alias("a"), "b").distinct()


class Found:
    """Sets joined so far within a task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def search(sets: list[np.ndarray], queries: list[int], against: list[int], found: Found) -> list[tuple[int, int]]:
    """Links (i, j) that join components, of each query with the sets in ``against``, or with the queries before it if that is empty."""
    lists: dict[int, list[int]] = {}
    for j in against:
        for s in sets[j].tolist():
            lists.setdefault(s, []).append(j)
    links = []
    for i in queries:
        own, n = sets[i].tolist(), len(sets[i])
        mine = sorted((lists[s] for s in own if s in lists), key=len)
        needed = required(n)
        if len(mine) >= needed:
            longest = len(mine[-1])
            long = min(needed - 1, int(needed / (MU * np.log2(longest + 1) + 1)))
            short, probed = mine[: len(mine) - long], mine[len(mine) - long :]
            last, count, met = -1, 0, []
            for j in heapq.merge(*short):
                if j == last:
                    count += 1
                else:
                    if count >= needed - long:
                        met.append((count, last))
                    last, count = j, 1
            if count >= needed - long:
                met.append((count, last))
            for count, j in sorted(met, reverse=True):
                m = len(sets[j])
                if j == i or found.root(i) == found.root(j) or 100 * min(n, m) < PERCENT * max(n, m):
                    continue
                least, left = -(-PERCENT * (n + m) // (100 + PERCENT)), long
                for entries in probed:
                    if count + left < least:
                        break
                    at = bisect_left(entries, j)
                    count += at < len(entries) and entries[at] == j
                    left -= 1
                if count >= least:
                    found.join(i, j)
                    links.append((i, j))
        if not against:
            for s in own:
                lists.setdefault(s, []).append(i)
    return links


def _search_tasks(rows: DataFrame, tasks: int) -> DataFrame:
    """a, b: links found in each cell. rows: cell, role (0 member, 1 leader or query), key, comp (null or a component so far), shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, cell in pdf.groupby("cell", sort=False):
            within = bool(cell["within"].iloc[0])  # a leader stands in its own block too; a query may also be one of those searched
            cell = cell.sort_values(["role", "key"], ascending=[False, True], kind="stable").drop_duplicates(["key"] if within else ["key", "role"])
            keys, roles = cell["key"].tolist(), cell["role"].tolist()
            sets = [np.frombuffer(s, "u8") for s in cell["shingles"]]
            found, first = Found(len(keys)), {}
            for i, c in enumerate(cell["comp"].tolist()):
                if c is not None and c == c:
                    found.join(first.setdefault(c, i), i)
            if within:
                links = search(sets, list(range(len(keys))), [], found)
            else:
                links = search(sets, [i for i, r in enumerate(roles) if r == 1], [i for i, r in enumerate(roles) if r == 0], found)
            out_a += [keys[i] for i, _ in links]
            out_b += [keys[j] for _, j in links]
        return pd.DataFrame({"a": np.array(out_a, "i8"), "b": np.array(out_b, "i8")})

    spread = rows.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int"))
    return spread.groupBy("task").applyInPandas(run, "a long, b long")


def _with_group(rows: DataFrame, per_group: DataFrame, on: str, how: str = "inner", by: str = "key") -> DataFrame:
    """rows with the columns of their group, without one task for a large group."""
    if per_group.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(per_group), on, how)
    salted = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [on, "salt"], how).drop("salt")


def _apart(sides: DataFrame, unit: str, **kept) -> DataFrame:
    """For each unit (a list or group of sets with comp) that holds several components: its largest one, the blocks of its search and how many sets that copies.
    kept: further columns by the aggregates that make them, over sets and then over components."""
    parts = sides.groupBy(unit, "comp").agg(F.count("*").alias("c"), *[over_sets.alias(name) for name, (over_sets, _) in kept.items()])
    size, most = F.sum("c"), F.max("c")
    out = parts.groupBy(unit).agg(size.alias("size"), (size - most).alias("others"), F.max_by("comp", F.struct("c", "comp")).alias("main"), *[over_comps(name).alias(name) for name, (_, over_comps) in kept.items()])
    out = out.where("others > 0").withColumns({"blocks": F.ceil(F.col("size") / BLOCK).cast("int"), "query_blocks": F.ceil(F.col("others") / BLOCK).cast("int")})
    return out.withColumn("copies", F.expr("size * query_blocks + others * blocks")).drop("size", "others")


def links(sets: DataFrame, groups: DataFrame, firsts: DataFrame, n_sets: int, keep: Scratch) -> DataFrame:
    """a, b: links that connect all that is connected. groups: key, grp; firsts: key, s."""
    least_of = [F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]
    large = groups.groupBy("grp").agg(F.count("*").alias("size"), *least_of).where(F.col("size") > BLOCK)
    large = keep(large.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "large")
    placed = _with_group(groups, large.select("grp", "blocks"), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = keep(placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "placed")
    common = [F.lit(True).alias("within"), "key", F.lit(None).cast("long").alias("comp"), "shingles"]
    members = placed.join(sets.select("key", "shingles"), "key").select(F.xxhash64("grp", "block").alias("cell"), F.lit(0).alias("role"), *common)
    leaders = large.select("grp", "blocks", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("key")).join(sets.select("key", "shingles"), "key")
    leaders = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("grp", "block").alias("cell"), F.lit(1).alias("role"), *common)
    first = keep(_search_tasks(members.unionByName(leaders), max(64, -(-n_sets // BLOCK))), "links")
    if large.isEmpty():
        return first
    comps = keep(components(first), "comps").select(F.col("node").alias("key"), F.col("label").alias("comp"))
    big = keep(placed.where("blocks > 1").select("key", "grp").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "big")
    whole = keep(_apart(big, "grp"), "whole")
    listed = keep(firsts.join(_with_group(big, whole.select("grp"), "grp", "left_semi"), "key"), "listed")  # key, s, grp, comp
    lists = _apart(listed, "s", grp=(F.min("grp"), F.min), x0=(F.bit_xor(F.xxhash64("key", F.lit(0))), F.bit_xor), x1=(F.bit_xor(F.xxhash64("key", F.lit(1))), F.bit_xor))
    names = ["s", "grp", "main", "blocks", "query_blocks", "copies"]
    lists = keep(lists.groupBy("x0", "x1").agg(F.min_by(F.struct(*names), "s").alias("l")).select("l.*"), "lists")  # lists of the same sets once
    cost = lists.groupBy("grp").agg(F.sum("copies").alias("by_list"))
    choice = keep(whole.join(cost, "grp", "left").withColumn("by_list", F.coalesce("by_list", F.lit(0))), "choice")
    use_lists = _with_group(lists, choice.where("by_list < copies").select("grp"), "grp", "left_semi", "s").drop("grp")
    use_whole = choice.where("by_list >= copies").drop("by_list")
    copies = choice.agg(F.sum(F.least("by_list", "copies"))).first()[0]
    if not copies:
        return first
    columns = ["unit", "key", "comp", "main", "blocks", "query_blocks"]
    by_list = _with_group(listed.drop("grp"), use_lists.drop("copies"), "s").withColumn("unit", F.xxhash64("s", F.lit("list"))).select(*columns)
    by_group = _with_group(big, use_whole.drop("copies"), "grp").withColumn("unit", F.xxhash64("grp", F.lit("group"))).select(*columns)
    sides = by_list.unionByName(by_group).withColumn("rest", F.col("comp") != F.col("main"))
    number = lambda of, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asking = sides.where("rest").withColumns({"q": number("query_blocks", 1), "role": F.lit(1)}).withColumn("block", every("blocks"))
    asked = sides.withColumns({"block": number("blocks", 2), "role": F.lit(0)}).withColumn("q", every("query_blocks"))
    cells = asking.unionByName(asked).select(F.xxhash64("unit", "block", "q").alias("cell"), "role", F.lit(False).alias("within"), "key", "comp").join(sets.select("key", "shingles"), "key")
    second = _search_tasks(cells.select("cell", "role", "within", "key", "comp", "shingles"), max(64, -(-copies // BLOCK)))
    return first.unionByName(keep(second, "links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the least id reachable by links, itself included), class_key (equal sets have equal keys), component_key (the same
    for what is linked), text_hash (xxhash64 of the text)."""
    keep = Scratch()
    digest = stored(digests(docs, id_col, text_col), "digests")
    classes = digest.where("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("least"), F.min("text_hash").alias("h"), F.first("n_shingles").cast("int").alias("n"))
    classes = stored(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    kept = keep(sieve(docs, classes.select("key", "n"), text_col, _buckets(total * (1 + EXTRA * 4) * (1 - PERCENT / 100))), "kept")
    wanted = classes.join(kept.select("key"), "key", "left_semi").select(F.col("least").alias("doc"), F.when(F.col("least").isNull(), F.col("h")).otherwise(0).alias("h"))
    sets = keep(full_sets(docs, wanted, id_col, text_col), "sets")
    n_sets, size = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = keep(rarest_shingles(sets, hot_shingles(sets, n_sets), _buckets(size)), "firsts")
    groups = keep(components(prefix_edges(firsts)).select(F.col("node").alias("key"), F.col("label").alias("grp")), "groups")
    joined = stored(components(links(sets, groups, firsts, n_sets, keep)).join(classes.select(F.col("key").alias("node"), "least"), "node"), "joined")
    keep.drop()
    least = joined.groupBy("label").agg(F.min("least").alias("component"))
    of_class = classes.select("key", "least").join(joined.select(F.col("node").alias("key"), "label"), "key", "left").join(least, "label", "left")
    of_class = of_class.select("key", F.coalesce("component", "least").alias("component"), F.coalesce("label", "key").alias("component_key"))
    out = digest.join(of_class, "key", "left")
    return out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"), F.col("key").alias("class_key"), "component_key", "text_hash")


def beside_first(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, text_hash of what isn't the first of its component in jaccard_components: the row with its least id (null ids last), of several texts with this id the one with
    the least hash. Rows that repeat id and text are one document; texts without shingles are their own component."""
    leading = found.where(F.col("component_key").isNotNull() & F.col(id_col).eqNullSafe(F.col("component_id")))
    least = leading.groupBy("component_key").agg(F.min("text_hash").alias("__first"))
    also = leading.join(least, "component_key").where(F.col("text_hash") != F.col("__first"))
    other = found.where(F.col("component_key").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("component_id")))
    return other.select(id_col, "text_hash").unionByName(also.select(id_col, "text_hash")).distinct()


def _buckets(shingles: float) -> int:
    return int(max(512, shingles / BUCKET_SHINGLES))
