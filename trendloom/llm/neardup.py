"""Near-duplicate documents by SetSketch registers.

Every set of word shingles becomes ``REGISTERS`` registers. Register i is the
exponentially spaced rank of the least of exponential variables that a hash gives the
shingles: floor(1 - log_B(min)), truncated to 0..TOP. Registers of a union are the
maxima of the parts' registers. ``BANDS`` groups of ``ROWS`` register values are the
keys under which similar sets meet. Then, without ever listing all pairs of a bucket:

1. Equal sets are collapsed to the least id.
2. In each bucket every set is paired with the bucket's hub: the member that shares
   most buckets with most others, so the one with the fewest changes of its own. A hub
   with one partner only is compared by the joint likelihood of the registers first.
   The other pairs' full sets are compared, which gives links, and each member's
   difference from the hub.
3. |A ^ B| = |Da| + |Db| - 2 |Da & Db| for two members' differences Da, Db from one
   hub. Unless both are linked with the hub (and so in one component already), A and B
   can only be linked if Da and Db share so many elements that they share one in their
   prefixes (see ``_prefixes``). Members that share such an element are paired if
   they are at most ``RARE`` and their differences' sizes, places and marks allow a
   link; more of them get a hub of their own, and step 2 and 3 are done with that. Near
   copies that each have changes of their own make no pairs.
4. Those pairs are estimated by the joint likelihood of their registers, and confirmed
   on the full sets unless the registers rule them out.
5. Components of all links are the result.

No link between sets that share a bucket is lost but by the likelihood (see
``RULED_OUT``). At similarity 0.85 a pair shares no bucket with a probability below
1e-6, at 0.8 below 1e-4.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trendloom.llm.shared import ascii_words, counted, forget_tables, materialise, observed
from trendloom.operators.records import numbered

#: The sketch: base, rate and largest value of registers, and their number.
BASE, RATE, TOP = 1.001, 20.0, 65534
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Distinct words whose hashes a task remembers.
MEMO_WORDS = 100_000
#: A hub's members are dealt to tasks in parts of about so many.
HUB_PART = 64
#: At most so many members that share an element are paired with each other directly.
RARE = 256
#: Hubs of hubs' groups are taken so often; what is left then is paired directly.
LEVELS = 5
#: Columns of the marks of a difference, 64 in each.
MARKS = ("s0", "s1", "s2", "s3")
#: Log-likelihood by which the threshold must lose for a pair to be dropped unconfirmed.
RULED_OUT = 10.0


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mix(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the public splitmix64 finaliser)."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def shingle_set(text: str | None, words: _WordHash, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text. Words are runs of
    anything but ASCII white space, with A-Z in lower case; fewer words than width
    make one shingle; none make an empty set."""
    found = ascii_words((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(width, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def _multipliers() -> np.ndarray:
    return _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; an empty set's are 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    least = np.full((REGISTERS, len(full)), np.iinfo(np.uint64).max, np.uint64)
    factors = _multipliers()
    # Blocks of sets that fit in the cache; a long set is cut, as minima are mergeable.
    # A cut that fills a block ends it, so no set is twice in one block.
    block: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not block:
            return
        joined = np.concatenate(block)
        starts = np.cumsum([0, *map(len, block[:-1])])
        rows = np.array(owners)
        for k in range(REGISTERS):
            v = joined * factors[k]
            v ^= v >> np.uint64(32)
            least[k, rows] = np.minimum(least[k, rows], np.minimum.reduceat(v * factors[k], starts))
        block.clear()
        owners.clear()
        held = 0

    for row, i in enumerate(full):
        for s in range(0, len(sets[i]), 32768):
            block.append(sets[i][s : s + 32768])
            owners.append(row)
            held += len(block[-1])
            if held >= 32768:
                flush()
    flush()
    u = (least.T.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)).copy()
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return acc.view(np.int64)


def joint_log_likelihood(above: np.ndarray, below: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of similarity, given how many registers are larger in a, larger in b and equal,
    and the sizes of the sets. As the base nears 1 the three cases have the
    probabilities |A\\B|, |B\\A| and |A and B| over |A or B|; a base above 1 moves a share
    of the first two, (B-1)/2 at most, to the third, which is added here."""
    both = similarity * (na + nb) / (1 + similarity)
    union = np.maximum(na + nb - both, 1e-9)
    tie = (BASE - 1) / 2
    pa = np.maximum((na - both) / union * (1 - tie), 1e-12)
    pb = np.maximum((nb - both) / union * (1 - tie), 1e-12)
    pe = np.maximum(1 - pa - pb, 1e-12)
    return above * np.log(pa) + below * np.log(pb) + (REGISTERS - above - below) * np.log(pe)


def _ruled_out(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the registers speak against any similarity at or over the threshold."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    here = joint_log_likelihood(above, below, na, nb, np.minimum(similarity, most))
    grid = np.linspace(0.0, 1.0, 41)
    every = np.stack([joint_log_likelihood(above, below, na, nb, np.minimum(g, most)) for g in grid])
    best = np.minimum(grid[every.argmax(axis=0)], most)
    return (best < similarity) & (every.max(axis=0) - here > RULED_OUT)


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (a hash of the text), n (set size), k1, k2 (128-bit key of the set), bands,
    regs."""
    import pyarrow as pa

    def run(batches):
        forget_tables()
        words = _WordHash()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sets = [shingle_set(t, words, width) for t in batch.column("text").to_pylist()]
                regs = registers(sets)
                k1 = np.array([int(_mix(s + np.uint64(1)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
                k2 = np.array([int(_mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
                bands = band_keys(regs)
                offsets = np.arange(0, BANDS * (len(sets) + 1), BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())), pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    names=["id", "t", "n", "k1", "k2", "bands", "regs"],
                )

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(
        run, "id long, t long, n long, k1 long, k2 long, bands array<long>, regs binary"
    )


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that registers and sizes don't rule out."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            keep = pa.array(~_ruled_out(ra, rb, na, nb, similarity))
            yield batch.select(["a", "b"]).filter(keep)

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _dealt(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text: every pair's b with its text sent to its hub a, whose own row comes
    first. A hub of many pairs is dealt to several tasks, each with a's text."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_PART)).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    hubs = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = members.unionByName(hubs).join(texts.withColumnRenamed("id", "b"), "b")
    return sent.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a")).select("a", "b", "text")


def _sets_with_hubs(batches, width: int):
    """For each batch, (a, b, hub's set, own set) of its pairs; a task holds one hub's
    set and one other at a time."""
    forget_tables()
    words = _WordHash()
    hub, held = None, np.empty(0, np.uint64)

    def of(batch):
        nonlocal hub, held
        for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text"))):
            own = shingle_set(text, words, width)
            if a == b:
                hub, held = a, own
            elif hub != a:
                raise ValueError(f"pair ({a}, {b}) came before its hub")
            else:
                yield a, b, held, own

    for whole in batches:
        for lo in range(0, whole.num_rows, 200):
            yield of(whole.slice(lo, 200))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    import pyarrow as pa

    def run(batches):
        for rows in _sets_with_hubs(batches, width):
            out = []
            for a, b, held, own in rows:
                both = len(np.intersect1d(held, own, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(own) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return _dealt(pairs, texts).mapInArrow(run, "a long, b long")


def _prefixes(g: int, l: int, n: int, hub: int, percent: int) -> tuple[bool, int, int]:
    """(linked, k, m) of a member of n elements, g of them not in its hub of ``hub``
    elements, which has l others. The first k elements of its difference (first those
    gained, then those lost) hold one that it shares with every other unlinked member it
    could be linked with; the first m, one that it shares with every linked member (if
    it is unlinked) or unlinked member (if it is linked) that it could be linked with.

    With P = 100 + percent and Q = 100 - percent, A and B are linked if
    P |A ^ B| <= Q (|A| + |B|), that is if 2 P x >= Ea + Eb with x the number of common
    elements of their differences and E = P d - Q n. A is linked with the hub if
    Ea <= Q hub. As x <= Db, Eb is at least Ea - 2 Q |B|, and |B| at most
    100 |A| / percent; as |B| is at most hub + Db, Eb is at least 2 percent Db - Q hub.
    Sharing x elements means sharing one among the first d - x + 1 of each."""
    p, q, d = 100 + percent, 100 - percent, g + l
    e = p * d - q * n
    prefix = lambda least: max(0, d + 1 - max(1, -(-(e + least) // (2 * p))))
    if e <= q * hub:
        return True, 0, prefix(q * hub + 1)
    near = e - 2 * q * (100 * n // percent)
    return False, prefix(max(q * hub + 1, near)), prefix(max(2 * percent - q * hub, near)) if near <= q * hub else 0


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, linked, n, g, d, k, m, s0 to s3, keys: every pair of a hub a and a member b
    compared on the full sets, with the prefixes of b's difference from a (see _prefixes)
    and 256 marks, one for each element by its last bits."""
    import pyarrow as pa

    names = ["a", "b", "linked", "n", "g", "d", "k", "m", *MARKS]
    kinds = [pa.int64(), pa.int64(), pa.bool_()] + [pa.int64()] * (5 + len(MARKS))

    def run(batches):
        for rows in _sets_with_hubs(batches, width):
            out, keys, ends = [], [np.empty(0, np.uint64)], [0]
            for a, b, held, own in rows:
                gained, lost = np.setdiff1d(own, held, assume_unique=True), np.setdiff1d(held, own, assume_unique=True)
                linked, k, m = _prefixes(len(gained), len(lost), len(own), len(held), percent)
                both, marks = np.concatenate([gained, lost]), np.zeros(64 * len(MARKS), bool)
                marks[both % np.uint64(len(marks))] = True
                out.append((a, b, linked, len(own), len(gained), len(both), k, m, *np.packbits(marks).view(np.int64).tolist()))
                keys.append(both[: max(k, m)])
                ends.append(ends[-1] + len(keys[-1]))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "keys"])

    schema = f"a long, b long, linked boolean, n long, g long, d long, k long, m long, {', '.join(f'{c} long' for c in MARKS)}, keys array<long>"
    return _dealt(pairs, texts).mapInArrow(run, schema)


def _open_keys(compared: DataFrame) -> DataFrame:
    """a, h, side, b, linked, n, d, rg, rl, marks: the prefixes' elements in the groups of
    hubs that some member isn't linked with. side is 0 between unlinked members, 1
    between an unlinked and a linked one; rg and rl count the gained and lost elements
    behind h."""
    mixed = compared.groupBy("a").agg(F.count_if(~F.col("linked")).alias("open"), F.count("*").alias("all")).where("open > 0 and all > 1").select("a")
    rows = compared.join(mixed, "a").select("a", "b", "linked", "n", "g", "d", "k", "m", *MARKS, F.posexplode("keys").alias("at", "h"))
    side = F.filter(F.array(F.when(F.col("at") < F.col("k"), 0), F.when(F.col("at") < F.col("m"), 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("side", F.explode(side))
    rg = F.greatest(F.col("g") - 1 - F.col("at"), F.lit(0))
    return rows.select("a", "h", "side", "b", "linked", "n", "d", rg.alias("rg"), (F.col("d") - 1 - F.col("at") - rg).alias("rl"), *MARKS)


def _within(keys: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of members that share a key and may be linked."""
    p, q = 100 + percent, 100 - percent
    held = ("b", "linked", "n", "d", "rg", "rl", *MARKS)
    one = keys.select("a", "h", "side", *[F.col(c).alias(f"x_{c}") for c in held])
    two = keys.select("a", "h", "side", *[F.col(c).alias(f"y_{c}") for c in held])
    # Every mark that only one of them has is an element that only that one has.
    unlike = F.expr(" + ".join(f"bit_count(x_{c} ^ y_{c})" for c in MARKS)) * p <= (F.col("x_n") + F.col("y_n")) * q
    # At the first common element, all others are among those behind it.
    most = 2 * p * (1 + F.least("x_rg", "y_rg") + F.least("x_rl", "y_rl"))
    needed = p * (F.col("x_d") + F.col("y_d")) - q * (F.col("x_n") + F.col("y_n"))
    apart = F.expr("(side = 0 and x_b < y_b) or (side = 1 and not x_linked and y_linked)")
    pairs = one.join(two, ["a", "h", "side"]).where(apart & unlike & (most >= needed) & _near_sizes(F.col("x_n"), F.col("y_n"), percent))
    return pairs.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b"))


def _links(stars: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """All links (a, b) between members of one hub's group; stars are pairs (hub, member)."""
    links, wanted = [], []
    for level in range(LEVELS):
        compared = materialise(_compared(stars, texts, width, percent))
        links.append(compared.where("linked").select("a", "b"))
        keys, n = counted(_open_keys(compared))
        if not n:
            break
        shared = keys.groupBy("a", "h", "side").agg(
            F.count("*").alias("all"), F.count_if("linked").alias("ends"), F.min(F.struct("d", "b"))["b"].alias("hub")
        )
        shared = shared.where("all > 1 and (side = 0 or (ends > 0 and ends < all))")
        small = F.col("all") <= (RARE if level < LEVELS - 1 else 1 << 62)
        wanted.append(_within(keys.join(shared.where(small).select("a", "h", "side"), ["a", "h", "side"]), percent))
        again = keys.join(shared.where(~small).select("a", "h", "side", "hub"), ["a", "h", "side"]).where("b != hub")
        stars, n = counted(again.select(F.col("hub").alias("a"), "b").distinct())
        if not n:
            break
    if wanted:
        pairs, n = counted(reduce(DataFrame.unionByName, wanted).distinct())
        if n:
            links.append(materialise(_confirmed(_likely(pairs, sets, percent / 100), texts, width, percent)))
    return reduce(DataFrame.unionByName, links)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of all ids in edges (a, b), a != b; component is the least id
    reachable. Alternates large-star and small-star steps; a node's neighbours are
    only ever aggregated, never gathered."""
    prints = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    edges, seen = observed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), *prints)
    for _ in range(most_rounds):
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, now = observed(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), *prints)
        if now == seen:
            roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept: for every row its set size, the least id
    reachable over links, and whether that is its own.

    Two sets are linked if 100 * intersection >= percent * union. A text without words
    (null, empty, white space) has an empty set and is linked with nothing. Rows that
    repeat an id count as one document: with different sets, the least non-empty one (by
    size, then key) speaks for the id, and the component is that set's. A row with a
    null id is linked with nothing: component_id null, kept true. An empty table
    gives no rows. Other columns aren't read. Ids that aren't whole numbers are numbered
    in their order first, which moves the texts once more.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        names = numbered(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_name")).distinct(), ["_name"]).select("_name", "_i")
        rows = docs.select(F.col(id_col).alias("_name"), F.col(text_col).alias("text")).join(names, "_name", "left")
        out = near_duplicates(rows.select("_i", "text"), width, percent, "_i", "text")
        other = names.select(F.col("_i").alias("component_id"), F.col("_name").alias("_least"))
        out = out.join(names, "_i", "left").join(other, "component_id", "left")
        return out.select(F.col("_name").alias(id_col), "n_shingles", F.col("_least").alias("component_id"), "kept")
    keys = ["n", "k1", "k2"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = materialise(sketch(rows, width, "id", "text"))
    owned = full.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct(*keys, "t")).alias("o")).select("id", "o.*")
    owned = materialise(owned)
    groups = materialise(owned.groupBy(*keys).agg(F.min(F.struct("id", "t")).alias("o")).select("o.id", "o.t", *keys))
    sets = full.where("n > 0").join(groups, ["id", "t", *keys], "left_semi").dropDuplicates(["id"]).select("id", "n", "bands", "regs")
    sets = materialise(sets)

    # A set's fame is the number of others in its buckets, with repeats.
    placed = sets.select("id", "n", F.explode("bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    placed = materialise(placed.join(sizes, "band"))
    fame = placed.groupBy("id").agg(F.sum("size").alias("fame"))
    placed = placed.select("id", "band").join(fame, "id")
    hubs = placed.groupBy("band").agg(F.max(F.struct("fame", (-F.col("id")).alias("id")))["id"].alias("hub"))
    stars = placed.join(hubs, "band").select((-F.col("hub")).alias("a"), F.col("id").alias("b")).where("a != b").distinct()
    stars, n = counted(stars)
    if n:
        alone = stars.groupBy("a").agg(F.count("*").alias("m")).where("m = 1").select("a")
        few = _likely(stars.join(alone, "a"), sets, percent / 100)
        stars = materialise(few.unionByName(stars.join(alone, "a", "left_anti")))
    # Texts of the sets that share a bucket, moved once. Written as a difference, the
    # second condition is no join key, so that the rows stay dealt by id.
    near = groups.select("id", F.col("t").alias("own")).join(placed.select("id").distinct(), "id")
    texts = rows.withColumn("t", F.xxhash64("text")).join(near, "id").where("(t ^ own) = 0").select("id", "text").dropDuplicates(["id"])
    found = components(_links(stars, sets, materialise(texts), width, percent)) if n else None

    out = full.select("id", "n").join(owned.select("id", *[F.col(k).alias(f"o_{k}") for k in keys]), "id", "left")
    if found is not None:
        named = groups.select(F.col("id").alias("rep"), *[F.col(k).alias(f"o_{k}") for k in keys]).join(found.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        named = groups.select(F.col("id").alias("rep"), *[F.col(k).alias(f"o_{k}") for k in keys], F.lit(None).cast("long").alias("component"))
    named = named.select(*[f"o_{k}" for k in keys], F.coalesce("component", "rep").alias("c"))
    out = out.join(named, [f"o_{k}" for k in keys], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
