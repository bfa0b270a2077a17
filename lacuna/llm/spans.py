"""Long spans that stand verbatim in more than one record, found incrementally.

A log-structured fingerprint index: a batch of new records becomes a sorted, immutable run of (hash, record, context), bucketed by
hash in a folder. A batch is merge-joined with itself and with each historical run (whose side needs no shuffle), and when a level
has `FANOUT` runs they are merged into one of the next level, so a record is rewritten log(batches) times in all. A manifest names
the runs, the batches that are in them and the matches found so far; `FingerprintIndex.open` takes it up in a later session, and a
batch that is there already isn't added again.

Fingerprints are hashes of `SEED` characters, and of the seeds that begin in a window of `WINDOW` characters the one with the
least hash is kept (the first of equals). Equal windows keep equal seeds, so records that share a window share a kept seed,
while only about one place in nine is stored. Each is stored with the characters around it that a window with this seed can
have, so a match is verified on the text itself, in the join: seed and characters on both sides are equal over `WINDOW` characters
or more. A seed that very many places have (a stock phrase, which may be shorter than a window) isn't joined by its hash alone:
its places are spread by the hashes of their windows, so only those that share a whole window meet.

Records with the same text are one class with one representative in the index; members are added to the pairs at the end.
Records can be of any length: texts are cut into chunks that overlap by a window, and texts that are given word by word are
joined in chunks of words, so no task holds a whole record; a chunk belongs to the batch in which its last word came. How much
of a record is shared is counted from the verified matches: the union of the stretches around their seeds.

Hashing runs in Arrow batches with NumPy: measured on four million windows, the JVM's higher-order functions took 2.3
microseconds for each, NumPy a tenth of that.

Defined results: null keys and null texts belong to no record; texts shorter than the window share nothing; of several
deliveries of a record the last one's text counts; null words are left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import distributed_rank, running_total, salted_join

WINDOW, SEED, FANOUT = 40, 24, 4
#: Places of a seed in a run, beyond which it is joined by its windows.
HOT = 1000
#: Characters before a seed that a window with it can have, and so after it.
SIDE = WINDOW - SEED
#: Characters and words in a chunk; words around it that complete its windows (each has a blank at least).
CHUNK, WORDS, HALO = 512, 128, WINDOW


def chunks_of_texts(records: DataFrame) -> DataFrame:
    """(tab, key, batch, chunk, base, body, left, starts) from (tab, key, batch, text): `starts` windows begin in the chunk,
    after `left` characters of the chunk before it."""
    n = F.length("text")
    d = records.where(n >= WINDOW).withColumn("n", n)
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - WINDOW) / CHUNK).cast("int"))))
    at = F.col("chunk") * CHUNK
    left = F.when(F.col("chunk") > 0, SIDE).otherwise(0)
    return d.select(
        "tab",
        "key",
        "batch",
        F.col("chunk").cast("long").alias("chunk"),
        at.cast("long").alias("base"),
        F.substring("text", at - left + 1, left + F.lit(CHUNK + WINDOW + SIDE)).alias("body"),
        left.alias("left"),
        F.least(F.lit(CHUNK), F.col("n") - WINDOW + 1 - at).alias("starts"),
    )


def chunks_of_words(words: DataFrame, order: str) -> DataFrame:
    """The same from (tab, key, batch, word, <order>), one row for each word, joined by single blanks in that order."""
    d = distributed_rank(words, ["tab", "key"], F.floor(F.col(order) / 4096), [order], "rank")
    c, at = F.floor(F.col("rank") / WORDS), F.col("rank") % WORDS
    after = HALO + SIDE
    places = F.filter(F.array(c, F.when((at < after) & (c > 0), c - 1), F.when(at >= WORDS - SIDE, c + 1)), lambda x: x.isNotNull())
    d = d.select("tab", "key", "batch", "rank", "word", c.alias("own"), F.explode(places).alias("chunk"))

    def part(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "word"))))

    own, chunk = F.col("own"), F.col("chunk")
    g = d.groupBy("tab", "key", "chunk").agg(
        F.max("batch").alias("batch"),
        part(own == chunk).alias("core"),
        part(own > chunk).alias("halo"),
        part(own < chunk).alias("pre"),
    )
    g = g.where(F.size("core") > 0)  # the words before a chunk that isn't there
    join = lambda x: F.array_join(F.col(f"{x}.word"), " ")
    g = g.select("tab", "key", "batch", "chunk", join("core").alias("core"), F.size("halo").alias("after"), join("halo").alias("halo"), F.when(F.size("pre") > 0, F.concat(join("pre"), F.lit(" "))).otherwise("").alias("pre"))
    pre = F.substring("pre", F.greatest(F.lit(1), F.length("pre") - SIDE + 1), F.lit(SIDE))
    rest = F.when(F.col("after") > 0, F.concat("core", F.lit(" "), "halo")).otherwise(F.col("core"))
    own_n = F.length("core") + F.when(F.col("after") > 0, 1).otherwise(0)
    g = g.select("tab", "key", "batch", "chunk", F.concat(pre, rest).alias("body"), F.length(pre).alias("left"), own_n.alias("own"))
    g = running_total(g, ["tab", "key"], F.floor(F.col("chunk") / 1024), ["chunk"], F.col("own"), "base")
    starts = F.greatest(F.lit(0), F.least(F.col("own"), F.length("body") - F.col("left") - WINDOW + 1))
    return g.select("tab", "key", "batch", "chunk", "base", "body", "left", starts.alias("starts"))


def _hashes(codes, size: int):
    """64-bit hashes of all runs of `size` codes: differences of a running sum of powers, scaled back, then mixed. Sums wrap."""
    import numpy as np

    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
        back = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(codes)
        power, inverse = np.full(n, base, dtype=np.uint64), np.full(n, back, dtype=np.uint64)
        power[:1] = inverse[:1] = 1
        power, inverse = np.cumprod(power), np.cumprod(inverse)
        mixed = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((mixed + np.uint64(1)) * power)))
        h = (total[size:] - total[:-size]) * inverse[: n - size + 1]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        return h ^ (h >> np.uint64(32))


_RUN = "tab string, h long, key string, left int, context string, ats array<bigint>"


def seeds(chunks: DataFrame) -> DataFrame:
    """(tab, h, key, left, context, ats): the kept seeds, each with up to SIDE characters on either side, `left` of them before,
    and its places in the record. Places with the same context that are in chunks read together are one row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def sort_out(b):
            bodies = b.column("body").to_pylist()
            size = np.array([len(x) for x in bodies], dtype=np.int64)
            at = np.cumsum(size) - size
            text = "".join(bodies)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            if len(codes) < WINDOW:
                return None
            h = _hashes(codes, SEED)
            left, starts, base = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("left", "starts", "base"))
            row = np.repeat(np.arange(len(bodies)), starts)
            w = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts) + (at + left)[row]
            kept, owner = [], []
            views = np.lib.stride_tricks.sliding_window_view(h, SIDE + 1)
            for x in range(0, len(w), 200_000):
                p = w[x : x + 200_000]
                p = p + views[p].argmin(axis=1)
                new = np.ones(len(p), dtype=bool)
                new[1:] = p[1:] != p[:-1]  # neighbours keep the same seed
                kept.append(p[new])
                owner.append(row[x : x + 200_000][new])
            p, o = np.concatenate(kept), np.concatenate(owner)
            lo, hi = np.maximum(at[o], p - SIDE), np.minimum((at + size)[o], p + SEED + SIDE)
            context = [text[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
            place, before, hp = (base - left - at)[o] + p, (p - lo).astype(np.int32), h[p].astype(np.int64)
            ends = np.arange(1, len(p) + 1)
            who = b.column("key").dictionary_encode().indices.to_numpy(zero_copy_only=False)[o]
            order = np.lexsort((hp, who))
            again = (who[order][1:] == who[order][:-1]) & (hp[order][1:] == hp[order][:-1])
            if again.any():  # a record that repeats itself
                first: dict = {}
                many = set(order[1:][again].tolist()) | set(order[:-1][again].tolist())
                lists = [[] for _ in range(len(p))]
                for i in range(len(p)):
                    k = first.setdefault((who[i], hp[i], before[i], context[i]), i) if i in many else i
                    lists[k].append(place[i])
                keep = np.array([i for i, x in enumerate(lists) if x])
                ends, place = np.cumsum([len(lists[i]) for i in keep]), np.array([v for x in lists for v in x], dtype=np.int64)
                o, hp, before, context = o[keep], hp[keep], before[keep], [context[i] for i in keep]
            take = pa.array(o)
            ats = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(place))
            return pa.RecordBatch.from_arrays([b.column("tab").take(take), pa.array(hp), b.column("key").take(take), pa.array(before), pa.array(context, pa.string()), ats], names=["tab", "h", "key", "left", "context", "ats"])

        for b in batches:
            for x in range(0, b.num_rows, 2000):
                got = sort_out(b.slice(x, 2000))
                if got is not None and got.num_rows:
                    yield got

    d = chunks.where("starts > 0").select("tab", "key", "base", "body", "left", "starts")
    return d.mapInArrow(run, _RUN)


_MATCH = "tab string, key_a string, key_b string, before int, after int, ats_a array<bigint>, ats_b array<bigint>"


class FingerprintIndex:
    """Sorted runs of kept seeds by level, in a folder. `add` matches a batch against all that is there and then keeps it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = FANOUT, hot: int = HOT) -> None:
        self.spark, self.path = spark, path
        self.state: dict = {"buckets": buckets, "fanout": fanout, "hot": hot, "levels": [[]], "batches": [], "matches": [], "version": 0}
        self._tables: dict[str, str] = {}

    # ------------------------------------------------------------ folder
    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 8, fanout: int = FANOUT, hot: int = HOT) -> FingerprintIndex:
        """The index in a folder with its runs, or a new one."""
        out = cls(spark, path, buckets, fanout, hot)
        fs, jvm_path = out._fs()
        found = fs.globStatus(jvm_path(f"{path}/manifest-*.json")) if fs.exists(jvm_path(path)) else []
        names = sorted(str(f.getPath()) for f in found)
        if names:
            out.state = json.loads(spark.read.text(names[-1], wholetext=True).first()[0])
        return out

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), make

    def _commit(self) -> None:
        """A new manifest; it is renamed into place, so a reader finds the old state or the new one."""
        self.state["version"] += 1
        fs, make = self._fs()
        name = f"manifest-{self.state['version']:08d}.json"
        out = fs.create(make(f"{self.path}/_{name}"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if not fs.rename(make(f"{self.path}/_{name}"), make(f"{self.path}/{name}")):
            raise RuntimeError(f"{name} is there already: another writer is at work")

    def _bucketed(self, at: str) -> DataFrame:
        if at not in self._tables:
            tab = f"lacuna_{uuid.uuid4().hex[:12]}"
            self.spark.sql(f"CREATE TABLE {tab} ({_RUN.replace(',', ', ')}) USING parquet CLUSTERED BY (tab, h) SORTED BY (tab, h) INTO {self.state['buckets']} BUCKETS LOCATION '{at}'")
            self._tables[at] = tab
        return self.spark.table(self._tables[at])

    def _write_run(self, kept: DataFrame) -> dict:
        """A run from rows that are hashed by (tab, h) into as many partitions as there are buckets: its folder, and that of
        its hot seeds if it has any."""
        at = f"{self.path}/run-{uuid.uuid4().hex[:12]}"
        tab = f"lacuna_{uuid.uuid4().hex[:12]}"
        kept.write.mode("overwrite").option("path", at).bucketBy(self.state["buckets"], "tab", "h").sortBy("tab", "h").saveAsTable(tab)
        self._tables[at] = tab
        # most seeds stand in one record only; those that don't are few, and all that matching a run with itself needs
        new = self.spark.table(tab)
        again = new.groupBy("tab", "h").count().where("count > 1").select("tab", "h", "count").hint("shuffle_hash")
        new.join(again, ["tab", "h"]).write.mode("overwrite").parquet(f"{at}-again")
        run = {"at": at, "again": f"{at}-again", "hot": None}
        n = self._again(run)
        if (n.agg(F.max("count")).first()[0] or 0) > self.state["hot"]:
            run["hot"] = f"{at}-hot"
            n.where(F.col("count") > self.state["hot"]).select("tab", "h").distinct().write.mode("overwrite").parquet(run["hot"])
        return run

    def _again(self, run: dict) -> DataFrame:
        return self.spark.read.schema(f"{_RUN}, count long").parquet(run["again"])

    def close(self) -> None:
        """Takes the runs' tables from the session; the files stay."""
        for t in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables = {}

    # ------------------------------------------------------------ batches
    @property
    def runs(self) -> list[dict]:
        return [r for level in self.state["levels"] for r in level]

    def add(self, kept: DataFrame, batch: str) -> None:
        """Keeps a batch of seeds and the matches of its records with each other and with all that is there."""
        if batch in self.state["batches"]:
            return
        new = self._write_run(kept.repartition(self.state["buckets"], "tab", "h"))
        found = self._match(new, new)
        for old in self.runs:
            found = found.unionByName(self._match(old, new))
        at = f"{self.path}/matches-{uuid.uuid4().hex[:12]}"
        found.write.mode("overwrite").parquet(at)
        self.state["levels"][0].append(new)
        self.state["matches"].append(at)
        self.state["batches"].append(batch)
        self._compact()
        self._commit()

    def matches(self) -> DataFrame:
        """(tab, key_a, key_b, before, after, ats_a, ats_b), key_a <> key_b: seeds that stand at ats_a and at ats_b, and how far
        the records agree on either side of them."""
        paths = self.state["matches"]
        return self.spark.read.schema(_MATCH).parquet(*paths) if paths else self.spark.createDataFrame([], _MATCH)

    def _match(self, old: dict, new: dict) -> DataFrame:
        if old is new:
            a = b = self._again(new).drop("count")
        else:
            # each side is first cut down, by hashes alone, to the seeds that the other one has
            a, b = self._bucketed(old["at"]), self._bucketed(new["at"])
            a, b = (x.join(y.select("tab", "h").distinct().hint("shuffle_hash"), ["tab", "h"], "left_semi") for x, y in ((a, b), (b, a)))
        hot = [self.spark.read.parquet(r["hot"]) for r in (old, new) if r["hot"]]
        if not hot:
            return self._verified(a, b, ["tab", "h"], old is new)
        some = hot[0].unionByName(hot[-1]).distinct()
        cold = self._verified(a.join(some, ["tab", "h"], "left_anti"), b.join(some, ["tab", "h"], "left_anti"), ["tab", "h"], old is new)

        def by_window(d: DataFrame) -> DataFrame:
            # a window with the seed begins up to SIDE characters before it
            inside = F.sequence(F.greatest(F.lit(0), F.lit(WINDOW) - F.length("context") + F.col("left")), F.col("left"))
            w = F.explode(F.transform(inside, lambda x: F.xxhash64(F.substring("context", F.col("left") - x + 1, F.lit(WINDOW)), x)))
            d = d.join(some, ["tab", "h"], "left_semi").where(F.length("context") >= WINDOW).withColumn("w", w)
            # a record that repeats itself needs each window once, with its places (in a million characters)
            part = F.floor(F.get("ats", F.lit(0)) / 1_000_000)
            return d.groupBy("tab", "h", "w", "key", "left", "context", part).agg(F.flatten(F.collect_list("ats")).alias("ats")).repartition("tab", "h", "w")

        return cold.unionByName(self._verified(by_window(a), by_window(b), ["tab", "h", "w"], old is new).distinct())

    def _verified(self, a: DataFrame, b: DataFrame, on: list[str], same: bool) -> DataFrame:
        cols = ("key", "left", "context", "ats")
        a, b = (d.select(*on, *[F.col(c).alias(f"{c}_{x}") for c in cols]) for d, x in ((a, "a"), (b, "b")))
        j = a.hint("merge").join(b, on).where(F.col("key_a") < F.col("key_b") if same else F.col("key_a") != F.col("key_b"))
        part = lambda x, at, n: F.substring(F.col(f"context_{x}"), F.col(f"left_{x}") + 1 + at, n)
        # one side or the other agrees over half its length at least, or there is no window; only then is each character compared
        near = SIDE // 2
        half = lambda at: (F.length(part("a", at, F.lit(SEED + near))) == SEED + near) & (part("a", at, F.lit(SEED + near)) == part("b", at, F.lit(SEED + near)))
        j = j.where(((F.least("left_a", "left_b") >= near) & half(F.lit(-near))) | half(F.lit(0)))

        def agree(most: Column, at) -> Column:  # the characters that are equal from the seed on, as a step that isn't breaks all later ones
            return F.size(F.filter(F.sequence(F.lit(0), most), lambda k: part("a", at(k), k) == part("b", at(k), k))) - 1

        before = agree(F.least("left_a", "left_b"), lambda k: -k)
        after = agree(F.least(F.length("context_a") - F.col("left_a"), F.length("context_b") - F.col("left_b")) - SEED, lambda k: F.lit(SEED))
        j = j.select("tab", "key_a", "key_b", before.alias("before"), after.alias("after"), "ats_a", "ats_b")
        return j.where(F.col("before") + F.col("after") >= SIDE)

    def _compact(self) -> None:
        k, levels = 0, self.state["levels"]
        while k < len(levels):
            if len(levels[k]) >= self.state["fanout"]:
                merged = self._bucketed(levels[k][0]["at"])
                for r in levels[k][1:]:
                    merged = merged.unionByName(self._bucketed(r["at"]))
                run = self._write_run(merged.repartition(self.state["buckets"], "tab", "h"))
                if k + 1 == len(levels):
                    levels.append([])
                levels[k] = []
                levels[k + 1].append(run)
            k += 1


class SharedSpans:
    """Records of one or more tables, added to an index batch by batch."""

    def __init__(self, chunks: DataFrame, work, index: FingerprintIndex) -> None:
        self.index = index
        chunks = work.save(chunks, "chunks")
        for (b,) in sorted(tuple(r) for r in chunks.select("batch").distinct().collect()):  # as many as periods of delivery
            index.add(seeds(chunks.where(F.col("batch") == b)), str(b))

    def pairs(self) -> DataFrame:
        """(tab, key_a, key_b), key_a < key_b: records that share a span."""
        m = self.index.matches()
        return m.select("tab", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()

    def covered(self) -> DataFrame:
        """(tab, key, covered): the characters of each record that stand in a window which another record has too. All matches
        of a place hold its seed, so the longest on either side are their union; then the places' stretches are merged."""
        m = self.index.matches()
        side = lambda x: m.select("tab", F.col(f"key_{x}").alias("key"), F.explode(f"ats_{x}").alias("at"), "before", "after")
        d = side("a").unionByName(side("b")).groupBy("tab", "key", "at").agg(F.max("before").alias("before"), F.max("after").alias("after"))
        d = d.select("tab", "key", (F.col("at") - F.col("before")).alias("s"), (F.col("at") + SEED + F.col("after")).alias("e"))
        # stretches are shorter than two windows: within parts of a record they are merged, and the parts' edges after that
        d = d.withColumn("part", F.floor(F.col("s") / 65_536))
        w = Window.partitionBy("tab", "key", "part").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        gain = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(w), F.lit(0))))
        parts = d.withColumn("gain", gain).groupBy("tab", "key", "part").agg(F.sum("gain").alias("gain"), F.min("s").alias("lo"), F.max("e").alias("hi"))
        # what runs over into the next part is counted there; what the next part's first stretches hold of it is taken off
        edge = d.select("tab", "key", (F.col("part") - 1).alias("part"), F.col("s").alias("s2"), F.col("e").alias("e2")).where("s2 < (part + 1) * 65536 + 80")
        edge = edge.join(parts.where("hi > (part + 1) * 65536").select("tab", "key", "part", "hi"), ["tab", "key", "part"]).where("s2 < hi")
        v = Window.partitionBy("tab", "key", "part").orderBy("s2", "e2").rowsBetween(Window.unboundedPreceding, -1)
        twice = F.greatest(F.lit(0), F.least("e2", "hi") - F.greatest("s2", F.coalesce(F.max("e2").over(v), F.lit(0))))
        over = edge.withColumn("twice", twice).groupBy("tab", "key", "part").agg(F.sum("twice").alias("twice"))
        both = parts.join(over, ["tab", "key", "part"], "left")
        return both.groupBy("tab", "key").agg(F.sum(F.col("gain") - F.coalesce("twice", F.lit(0))).alias("covered"))


def classes(records: DataFrame) -> DataFrame:
    """records(tab, key, batch, text) with `rep`, the least key of those with the same text, and `copies`."""
    g = records.groupBy("tab", "text").agg(F.min("key").alias("rep"), F.min("batch").alias("first"), F.count("*").alias("copies"))
    return salted_join(records, g, ["tab", "text"], ["key"], "inner")


def with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of representatives to pairs of all records: members(tab, rep, key). Pairs within a class are added."""
    a = members.select("tab", F.col("rep").alias("key_a"), F.col("key").alias("m_a"))
    b = members.select("tab", F.col("rep").alias("key_b"), F.col("key").alias("m_b"))
    out = pairs.join(a, ["tab", "key_a"], "left").join(b, ["tab", "key_b"], "left")
    out = out.select("tab", F.coalesce("m_a", "key_a").alias("x"), F.coalesce("m_b", "key_b").alias("y"))
    inside = a.join(b.withColumnRenamed("key_b", "key_a"), ["tab", "key_a"]).where("m_a < m_b").select("tab", F.col("m_a").alias("x"), F.col("m_b").alias("y"))
    both = out.unionByName(inside)
    return both.select("tab", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
