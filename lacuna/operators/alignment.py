"""Dynamic-programming kernels, in Arrow batches or bounded groups; everything that SQL can say is elsewhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import WorkDir
from .relational import top_per_group
from .skew import fan_out


# ---------------------------------------------------------------- kernels
def semiglobal(a: str, b: str) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of all of a to a substring of b: of equal edits the earliest end, and for it
    the earliest start. A row is a vector over b, so the work is len(a) vector steps."""
    import numpy as np

    if not a:
        return 0, 0, 0
    x, y = np.frombuffer(a.encode("utf-32-le"), "<u4"), np.frombuffer(b.encode("utf-32-le"), "<u4")
    m = len(y)
    # cost and start in one number, so that minima take the earliest start of equal costs
    big = m + 1
    step = np.arange(m + 1, dtype=np.int64)
    row = step.copy()
    for i, c in enumerate(x, 1):
        new = np.empty(m + 1, dtype=np.int64)
        new[0] = i * big
        new[1:] = np.minimum(row[:-1] + (y != c) * big, row[1:] + big)
        # letters of b left over in the middle: running minimum along the row
        row = np.minimum.accumulate(new - step * big) + step * big
    cost = row // big
    j = int(cost.argmin())
    return int(cost[j]), int(row[j] % big), j


def fewest_edits(a: str, texts: list[str], cells: int = 1 << 15):
    """The edits of `semiglobal` of a to each text, for many texts at once: a step is a vector over texts of like lengths."""
    import numpy as np

    x = np.frombuffer(a.encode("utf-32-le"), "<u4")
    out = np.zeros(len(texts), dtype=np.int64)
    order, first = sorted(range(len(texts)), key=lambda i: len(texts[i])), 0
    while first < len(order) and len(x):
        last = first + 1
        while last < len(order) and (last + 1 - first) * (len(texts[order[last]]) + 1) <= cells:
            last += 1
        part = order[first:last]
        m = len(texts[part[-1]])
        # letters that nothing equals fill up; to take one in costs as much as to leave a letter of a out
        y = np.zeros((m, len(part)), dtype="<u4")
        for k, i in enumerate(part):
            y[: len(texts[i]), k] = np.frombuffer(texts[i].encode("utf-32-le"), "<u4")
        step = np.arange(m + 1, dtype=np.int32)[:, None]
        row = np.zeros((m + 1, len(part)), dtype=np.int32)
        new = np.empty_like(row)
        same = {c: (y != c).astype(np.int32) for c in set(x.tolist())}
        for n, c in enumerate(x.tolist(), 1):
            new[0] = n
            np.add(row[:-1], same[c], out=new[1:])
            np.add(row, 1, out=row)
            np.minimum(new[1:], row[1:], out=new[1:])
            new -= step
            np.minimum.accumulate(new, axis=0, out=row)
            row += step
        out[part] = row.min(axis=0)
        first = last
    return out


#: Costs of a word alignment in millionths: a scroll word alone, a base word alone, an unreadable word with any, and the most
#: that two different words cost together. Whole numbers, so that equal costs are equal.
WORD_GAP, WORD_SKIP, WORD_UNKNOWN, WORD_MOST = 1_000_000, 600_000, 300_000, 1_200_000
_FOLD = str.maketrans("ךםןףץ", "כמנפצ")
_BARE = str.maketrans("ךםןףץ", "כמנפצ", "ויא")


@lru_cache(maxsize=1 << 16)
def word_cost(scroll: str, base: str) -> int:
    """0 for words that differ by spelling letters only, else by edits per letter of the longer one."""
    if scroll.translate(_BARE) == base.translate(_BARE):
        return 0
    return min(WORD_MOST, round(1_600_000 * edits(scroll.translate(_FOLD), base.translate(_FOLD)) / max(len(scroll), len(base), 1)))


def align_words(verses: Sequence[tuple[Sequence[str | None], Sequence[str]]]) -> list[list[tuple[int | None, int | None]]]:
    """Global alignments of many verses at once: for each (i, j) pairs of a scroll word and a base word, None for a gap. A null
    scroll word is unreadable. Of equal costs a pair comes before a scroll word alone, and that before a base word alone.

    A step takes one scroll word of all verses: its costs as a pair or alone are vectors over the base words, and base words
    left alone after it are a running minimum of the costs less their price. The path is read off the costs."""
    import numpy as np

    rows, cols = max((len(s) for s, _ in verses), default=0), max((len(b) for _, b in verses), default=0)
    pair = np.full((len(verses), rows, cols), WORD_MOST, dtype=np.int64)
    for v, (s, b) in enumerate(verses):
        for i, w in enumerate(s):
            pair[v, i, : len(b)] = [WORD_UNKNOWN if w is None else word_cost(w, x) for x in b]
    alone = np.arange(cols + 1, dtype=np.int64) * WORD_SKIP
    cost = np.empty((len(verses), rows + 1, cols + 1), dtype=np.int64)
    cost[:, 0] = alone
    for i in range(rows):
        best = cost[:, i] + WORD_GAP
        np.minimum(best[:, 1:], cost[:, i, :-1] + pair[:, i], out=best[:, 1:])
        cost[:, i + 1] = np.minimum.accumulate(best - alone, axis=1) + alone
    out = []
    for v, (s, b) in enumerate(verses):
        at, i, j = [], len(s), len(b)
        while i or j:
            here = cost[v, i, j]
            if i and j and here == cost[v, i - 1, j - 1] + pair[v, i - 1, j - 1]:
                i, j = i - 1, j - 1
                at.append((i, j))
            elif i and here == cost[v, i - 1, j] + WORD_GAP:
                i -= 1
                at.append((i, None))
            else:
                j -= 1
                at.append((None, j))
        out.append(at[::-1])
    return out


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def align_bands(pictures: Sequence[dict], width: float) -> list[list[tuple[int, int, float]]]:
    """(band, line, misfit) of many pictures at once, each with `bands` (y, x0, x1, strength), `lines` (label, letters, num) and
    `pitch`. A pair costs how far the band's width is from the text's, and how far its distance to the last matched band is from
    the difference of their line numbers; a band or a line may be left out at a price. One best state is kept for each pair of
    places, of equal ones a pair before a band left out before a line left out, as the distance cost looks back to it.

    All states whose places have the same sum are one step, for all pictures: they follow from the two steps before."""
    import numpy as np

    count = len(pictures)
    m, n = max((len(p["bands"]) for p in pictures), default=0), max((len(p["lines"]) for p in pictures), default=0)
    y, num = np.zeros((count, m + 1)), np.full((count, n + 1), np.nan)
    misfit, no_band, no_line = np.zeros((count, m + 1, n + 1)), np.ones((count, m + 1)), np.full((count, n + 1), 1.2)
    pitch = np.array([float(p["pitch"]) for p in pictures])
    for k, p in enumerate(pictures):
        bands, lines = p["bands"], p["lines"]
        y[k, : len(bands)] = [b["y"] for b in bands]
        no_band[k, : len(bands)] = [0.4 if b["strength"] < 0.35 else 1.0 for b in bands]
        num[k, : len(lines)] = [np.nan if x["num"] is None else x["num"] for x in lines]
        no_line[k, : len(lines)] = [0.3 if x["letters"] <= 2 else 1.2 for x in lines]
        wide = np.array([max(b["x1"] - b["x0"], 1) for b in bands], dtype=float)
        want = np.array([max(len(x["label"]), 1) for x in lines], dtype=float) * width * pitch[k]
        misfit[k, : len(bands), : len(lines)] = np.abs(np.log(wide[:, None] / want[None, :]))
    cost = np.full((count, m + 1, n + 1), np.inf)
    cost[:, 0, 0] = 0.0
    band_of, line_of = np.full((count, m + 1, n + 1), -1), np.full((count, m + 1, n + 1), -1)
    step = np.zeros((count, m + 1, n + 1), dtype=np.int8)
    every = np.arange(count)[:, None]
    for total in range(1, m + n + 1):
        i = np.arange(max(0, total - n), min(m, total) + 1)
        j = total - i
        a, b = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        last_band, last_line = band_of[:, a, b], line_of[:, a, b]
        apart = (y[every, a] - y[every, last_band]) / pitch[:, None] - (num[every, b] - num[every, last_line])
        far = np.where((last_band >= 0) & ~np.isnan(apart), 1.5 * np.abs(apart), 0.0)
        offers = np.stack([
            np.where((i > 0) & (j > 0), cost[:, a, b] + (misfit[:, a, b] + far), np.inf),
            np.where(i > 0, cost[:, a, j] + no_band[every, a], np.inf),
            np.where(j > 0, cost[:, i, b] + no_line[every, b], np.inf),
        ])
        took = offers.argmin(axis=0)
        cost[:, i, j], step[:, i, j] = offers.min(axis=0), took
        band_of[:, i, j] = np.where(took == 0, a, np.where(took == 1, band_of[:, a, j], band_of[:, i, b]))
        line_of[:, i, j] = np.where(took == 0, b, np.where(took == 1, line_of[:, a, j], line_of[:, i, b]))
    out = []
    for k, p in enumerate(pictures):
        i, j, found = len(p["bands"]), len(p["lines"]), []
        while i or j:
            took = step[k, i, j]
            i, j = i - (took != 2), j - (took != 1)
            if took == 0:
                found.append((i, j, float(misfit[k, i, j])))
        out.append(found[::-1])
    return out


def forced_frames(logps: Sequence, targets: Sequence[Sequence[int]]) -> list[list[list[int]] | None]:
    """Frames of each target symbol on the best path of each line (0 is the blank), for many lines at once; None if no path is
    long enough. Of equal paths the one that stays, then the one that comes from a blank.

    Two vectors for each line: the best score so far of paths that rest on a blank after k symbols, and of those that are in
    symbol k. A frame takes both of all lines one step on."""
    import numpy as np

    count, most = len(targets), max((len(t) for t in targets), default=0)
    never = -1e18
    frames = [len(x) for x in logps]
    wide = max((np.asarray(x).shape[1] for x in logps if len(x)), default=1)
    wide = max([wide, 1, *(max(t) + 1 for t in targets if len(t))])
    logps = [_padded(x, wide) for x in logps]
    sym = np.zeros((count, most + 1), dtype=np.int64)
    for k, t in enumerate(targets):
        sym[k, 1 : len(t) + 1] = t
    differs = np.zeros((count, most + 1), dtype=bool)
    differs[:, 2:] = sym[:, 2:] != sym[:, 1:-1]
    rest, inside = np.full((count, most + 1), never), np.full((count, most + 1), never)
    from_symbol, entered = [], []  # of each frame: whether the blank comes from its symbol; 0 stays, 1 from the blank, 2 from the symbol before
    ends = {}
    for t in range(max(frames, default=0)):
        live = np.array([t < f for f in frames])
        now = np.stack([x[min(t, len(x) - 1)] for x in logps])
        blank, letter = now[:, :1], np.take_along_axis(now, sym, axis=1)
        if t == 0:
            new_rest, new_inside = np.full_like(rest, never), np.full_like(inside, never)
            new_rest[:, 0] = blank[:, 0]
            new_inside[:, 1:2] = letter[:, 1:2]
            from_symbol.append(None)
            entered.append(None)
        else:
            over = inside > rest
            new_rest = np.where(over, inside, rest) + blank
            before_rest, before_in = np.roll(rest, 1, axis=1), np.where(differs, np.roll(inside, 1, axis=1), never)
            before_rest[:, 0] = never
            choice = np.stack([inside, before_rest, before_in])
            how = choice.argmax(axis=0)
            new_inside = choice.max(axis=0) + letter
            new_inside[:, 0] = never
            from_symbol.append(over)
            entered.append(how)
        rest, inside = np.where(live[:, None], new_rest, rest), np.where(live[:, None], new_inside, inside)
        for k in np.flatnonzero(live):
            if t + 1 == frames[k]:
                n = len(targets[k])
                ends[k] = (rest[k, n], inside[k, n])
    out: list[list[list[int]] | None] = []
    for k, target in enumerate(targets):
        n = len(target)
        if k not in ends or max(ends[k]) <= never / 2:
            out.append(None)
            continue
        found: list[list[int]] = [[] for _ in target]
        on_symbol = n > 0 and ends[k][0] < ends[k][1]
        for t in range(frames[k] - 1, -1, -1):
            if on_symbol:
                found[n - 1].append(t)
                if t:
                    how = entered[t][k, n]
                    n -= how > 0
                    on_symbol = how != 1
            elif t:
                on_symbol = bool(from_symbol[t][k, n])
        out.append([f[::-1] for f in found])
    return out


def _padded(x, wide: int):
    """Frames with `wide` columns; symbols that a line's frames don't have can't be read. One frame at least."""
    import numpy as np

    x = np.asarray(x, dtype=float) if len(x) else np.zeros((1, wide))
    return np.concatenate([x, np.full((len(x), wide - x.shape[1]), -1e18)], axis=1)


def greedy_symbols(logp) -> list[int]:
    """The likeliest symbol of each frame, repeats as one, blanks (0) dropped."""
    import numpy as np

    best = np.asarray(logp, dtype=float).argmax(axis=1) if len(logp) else np.zeros(0, dtype=int)
    new = np.ones(len(best), dtype=bool)
    new[1:] = best[1:] != best[:-1]
    return [int(x) for x in best[new] if x]


# ---------------------------------------------------------------- on DataFrames
def best_substring(pairs: DataFrame, a: str, b: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., edits, start, end): `semiglobal` of each row; null if either side is null, and an empty a fits with 0 edits."""
    schema = T.StructType([*[pairs.schema[k] for k in keep], *T._parse_datatype_string("edits int, start int, end int").fields])

    def run(batches):
        import pyarrow as pa

        n = len(keep)
        for t in batches:
            got = [semiglobal(x, y) if x is not None and y is not None else (None, None, None) for x, y in zip(t.column(n).to_pylist(), t.column(n + 1).to_pylist())]
            cols = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*t.columns[:n], *cols], names=[*keep, "edits", "start", "end"])

    return fan_out(pairs.select(*keep, F.col(a).alias("_a"), F.col(b).alias("_b"))).mapInArrow(run, schema)


#: Rows whose kernels run together.
TOGETHER = 256


def _in_batches(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], out: str, kernel) -> DataFrame:
    """(keep..., out columns): kernel(rows of inputs as dicts) gives a list of tuples for each row; rows with a null input have
    none."""
    schema = T.StructType([*[df.schema[k] for k in keep], *T._parse_datatype_string(out).fields])
    kinds = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x in range(0, batch.num_rows, TOGETHER):
                rows = [r for r in batch.slice(x, TOGETHER).to_pylist() if all(r[c] is not None for c in inputs)]
                got = [(*(r[k] for k in keep), *one) for r, many in zip(rows, kernel(rows)) for one in many]
                cols = list(zip(*got)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)  # by place, as names may clash

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


def aligned_words(groups: DataFrame, keep: Sequence[str], scroll: str, base: str) -> DataFrame:
    """(keep..., i, j): `align_words` of two arrays of words in each row (a verse, so of bounded length). Null arrays give nothing."""
    return _in_batches(groups, keep, [scroll, base], "i int, j int", lambda rows: align_words([(r[scroll], r[base]) for r in rows]))


def aligned_bands(df: DataFrame, keep: Sequence[str], bands: str, lines: str, pitch: str, width: float) -> DataFrame:
    """(keep..., band, line, misfit): `align_bands` of each row's array of bands and array of lines; a pitch of 0 gives nothing."""

    def kernel(rows):
        some = [r for r in rows if r[pitch]]
        done = iter(align_bands([{"bands": r[bands], "lines": r[lines], "pitch": r[pitch]} for r in some], width))
        return [[(i, j, round(c, 6)) for i, j, c in next(done)] if r[pitch] else [] for r in rows]

    return _in_batches(df, keep, [bands, lines, pitch], "band int, line int, misfit double", kernel)


def forced(df: DataFrame, keep: Sequence[str], logp: str, target: str) -> DataFrame:
    """(keep..., symbol, first, last): the frames of each target symbol, by its place in the target, by `forced_frames`; nothing where no path is long enough."""

    def kernel(rows):
        done: list = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][logp]))  # lines of like lengths together
        for x in range(0, len(order), 16):
            some = order[x : x + 16]
            for i, got in zip(some, forced_frames([rows[i][logp] for i in some], [rows[i][target] for i in some])):
                done[i] = got
        return [[(k, f[0], f[-1]) for k, f in enumerate(one or [])] for one in done]

    return _in_batches(df, keep, [logp, target], "symbol int, first int, last int", kernel)


def decoded(df: DataFrame, keep: Sequence[str], logp: str) -> DataFrame:
    """(keep..., symbols): the greedy reading of each row's frames."""
    return _in_batches(df, keep, [logp], "symbols array<int>", lambda rows: [[(greedy_symbols(r[logp]),)] for r in rows])


def nearest_text(readings: DataFrame, texts: DataFrame, group: str, query: str, a: str, doc: str, b: str, block: int = 1000) -> DataFrame:
    """(query, a, doc, edits): of all texts of a reading's groups the one in which it fits with the fewest edits, of equal ones the
    first. readings(group, query, a), a query in several groups or one; texts(group, doc, b). Every pair is compared."""

    def parts(df: DataFrame, key: str, name: str, what) -> DataFrame:
        n = df.groupBy(group).agg((F.floor(F.count("*") / block) + 1).alias("_n"))
        return df.join(n, group).groupBy(group, F.pmod(F.xxhash64(key), F.col("_n")).alias("_p")).agg(F.collect_list(what).alias(name)).drop("_p")

    # equal readings are compared once
    work = WorkDir(readings.sparkSession, "nearest")
    ids = work.save(readings.where(F.length(a) > 0).select(group, query, F.col(a).alias("_a")), "readings")
    q = parts(ids.select(group, "_a").distinct(), "_a", "_as", F.col("_a"))
    t = parts(texts.where(F.length(b) > 0), doc, "_ts", F.struct(F.col(doc).alias("doc"), F.col(b).alias("b")))
    d = q.join(t, group).select(group, "_as", "_ts")
    schema = T.StructType([readings.schema[group], T.StructField("_a", T.StringType()), texts.schema[doc], *T._parse_datatype_string("edits int").fields])
    names, kinds = schema.names, to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x in range(batch.num_rows):
                g, many, ts = (c[x].as_py() for c in batch.columns)
                ts.sort(key=lambda t: t["doc"])
                lines = [t["b"] for t in ts]
                rows = []
                for one in many:
                    e = fewest_edits(one, lines)
                    i = int(e.argmin())
                    rows.append(dict(zip(names, (g, one, ts[i]["doc"], int(e[i])))))
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    n = 8 * int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = d.repartition(n).mapInArrow(run, schema)
    best = top_per_group(best, [group, "_a"], [F.col("edits"), F.col(doc)], 1).drop("rank")
    return top_per_group(ids.join(best, [group, "_a"]), [query], [F.col("edits"), F.col(doc)], 1).select(query, F.col("_a").alias(a), doc, "edits")
