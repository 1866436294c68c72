"""MinHash near-duplicates: odd sketches estimate banded candidates, links are confirmed on full shingle sets."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, forget, small, table, written
from .shingles import U, blocks, hashed, mix

ROWS = 5
#: A linked pair shares no band with at most this probability.
MISS = 1e-6
BITS = 256
#: Samples and bits of the finer sketches, made of the documents that share a band only.
FINE_SAMPLES, FINE_BITS = 1024, 2048
#: A candidate is looked at in full unless its sketches differ more than at the threshold by so many standard deviations.
SLACK = 5.0
BROADCAST_IDS = 1_000_000

#: Lengths within this factor of each other share a class of the prefix join.
CLASS = 1.04
#: Classes at a place that are compared before all that are still apart are.
GROUP = 16
#: Where more pairs a class than this are still apart at a place, they meet by their differences from one class there.
CROWD = 32
#: Differences are counted by steps of so many.
STEP = 8

SIGN = T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def limit_for(threshold: float, samples: int, bits: int) -> int:
    """Most differing bits of two odd sketches that leave a similarity of ``threshold`` possible.

    Each of the samples that differ, binomial in number, flips two random bits.
    """
    expected = bits / 2 * (1 - math.exp(-4 * samples * (1 - threshold) / bits))
    slope = 2 * math.exp(-4 * samples * (1 - threshold) / bits)
    spread = math.sqrt(slope**2 * samples * threshold * (1 - threshold) + bits / 4 * (1 - math.exp(-8 * samples * (1 - threshold) / bits)))
    return math.ceil(expected + SLACK * spread)


def odd_sketches(least: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps, as rows of longs, of columns of MinHash samples: a sample flips the bit that its number and value name."""
    k = least.shape[1]
    flips = np.zeros(k * bits, np.int32)
    for i in range(0, len(least), 64):
        at = (mix(least[i : i + 64] ^ salt[i : i + 64, None]) % U(bits)).astype(np.int64) + np.arange(k) * bits
        flips += np.bincount(at.ravel(), minlength=k * bits).astype(np.int32)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(k, bits // 64) if k else np.zeros((0, bits // 64), np.int64)


def samples_of(x: np.ndarray, sizes: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples (rows) of the sets (columns) that are not empty."""
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    factor = mix(np.arange(1, samples + 1, dtype=U)) | U(1)
    least = np.empty((samples, len(starts)), U)
    for i in range(samples):
        least[i] = np.minimum.reduceat(x * factor[i], starts) if len(starts) else 0
    return least


def _salt(samples: int) -> np.ndarray:
    return mix(np.arange(1001, 1001 + samples, dtype=U))


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32), rows.ravel())


def sign(texts: list[bytes | None], n_bands: int) -> pa.StructArray:
    """SIGN of each text: size and 16-byte hash of its shingle set, hashes of its bands, odd sketch."""
    samples, salt = n_bands * ROWS, _salt(n_bands * ROWS)
    factor = mix(np.arange(1, ROWS + 1, dtype=U)) | U(1)
    n = np.zeros(len(texts), np.int64)
    key = np.zeros((len(texts), 2), U)
    bands, sketch = np.zeros((len(texts), n_bands), np.int64), np.zeros((len(texts), BITS // 64), np.int64)
    for first, x, sizes in blocks(texts):
        at = first + np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        n[first : first + len(sizes)] = sizes
        if not len(at):
            continue
        least = samples_of(x, sizes, samples)
        key[at] = np.stack([np.add.reduceat(v, starts) for v in (x, mix(x ^ U(0x5851F42D4C957F2D)))], 1)
        sums = mix((least.reshape(n_bands, ROWS, len(at)) * factor[:, None]).sum(1) + salt[:n_bands, None])
        bands[at] = np.ascontiguousarray(sums.T).view(np.int64)
        sketch[at] = odd_sketches(least, salt, BITS)
    return pa.StructArray.from_arrays([pa.array(n), pa.array([k.tobytes() for k in key], pa.binary()), _lists(bands), _lists(sketch)], SIGN.names)


def fine(texts: list[bytes | None]) -> pa.ListArray:
    """The finer odd sketch of each text."""
    out = np.zeros((len(texts), FINE_BITS // 64), np.int64)
    for first, x, sizes in blocks(texts, 200_000):
        out[first + np.flatnonzero(sizes)] = odd_sketches(samples_of(x, sizes, FINE_SAMPLES), _salt(FINE_SAMPLES), FINE_BITS)
    return _lists(out)


@lru_cache(64)
def _set(text: bytes) -> np.ndarray:
    return hashed(text)


def _linked(percent: int):
    def apply(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.cast(pa.binary()).to_pylist(), b.cast(pa.binary()).to_pylist()):  # noqa: B905
            x, y = _set(x), _set(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(apply, T.BooleanType())


def _alike(a: str, b: str, percent: int, samples: int, bits: int) -> Column:
    """Sizes and sketches of two sides allow a link."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(bits // 64)), F.lit(0))
    small_, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * small_ >= percent * large) & (differ <= limit_for(percent / 100, samples, bits))


def _length_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS)).cast("int")


def prefix_keys(tokens: DataFrame, percent: int) -> DataFrame:
    """(at, side, key, c, lo, hi): where classes of tokens(key, c, n, token), c their component, may meet one of another component.

    Two sets linked at the threshold have a number of shingles in common that their sizes tell, so among as many of the
    rarest of each as may be missing, and one more, there is a common one. Classes meet by those, in an order by how
    many classes have a shingle, apart for each pair of length classes, for then the bound is as tight as for known
    sizes: what many texts have in common (a template) is met last, and does not bring them together unless it makes them alike.
    side: 0 among texts of one length class; else -1 or 1, for texts of the shorter and the longer one, who meet each other.
    lo, hi: these classes.
    """
    known = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("x"), F.max("c").alias("y")).where("df > 1")
    known = known.select(F.col("token").alias("t"), "df", (F.col("x") != F.col("y")).alias("mixed"))
    lists = tokens.join(known, F.col("token") == F.col("t")).groupBy("key").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token", "mixed"))).alias("known"))
    low, high = F.floor(F.col("n") * percent / 100), F.ceil(F.col("n") * 100 / percent)
    own = _length_class(F.col("n"))
    lists = lists.withColumn("own", own).withColumn("theirs", F.explode(F.sequence(_length_class(F.greatest(low, F.lit(1))), _length_class(high))))
    # so many shingles in common at least with any text of that class; those no other text has come first
    shared = F.ceil((F.col("n") + F.floor(F.pow(F.lit(CLASS), F.col("theirs")))) * percent / (100 + percent))
    first = F.greatest(F.col("n") - shared + 1 - (F.col("n") - F.size("known")), F.lit(0)).cast("int")
    keyed = lists.select("key", "c", F.least("own", "theirs").alias("lo"), F.greatest("own", "theirs").alias("hi"), F.signum(F.col("own") - F.col("theirs")).cast("int").alias("side"), F.explode(F.slice("known", F.lit(1), first)).alias("k")).where("k.mixed")
    return keyed.select(F.xxhash64("k.token", "lo", "hi").alias("at"), "side", "key", "c", "lo", "hi").distinct()


def _mixed(keyed: DataFrame) -> DataFrame:
    """keyed with the least component at its place, where that is not the only one."""
    met = keyed.groupBy("at").agg(F.min("c").alias("hub"), F.max("c").alias("y"), F.min("side").alias("s"), F.max("side").alias("t")).where("hub <> y AND (s = 0 OR s <> t)")
    return keyed.join(met.select("at", "hub"), "at")


def star_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b), each once: every class with the least one that it meets at a place, if that is of another component."""
    hubs = keyed.groupBy("at", "side").agg(F.min(F.struct("key", "c")).alias("h")).select(F.col("at").alias("h_at"), (-F.col("side")).alias("h_side"), "h")
    met = keyed.join(hubs, (F.col("at") == F.col("h_at")) & (F.col("side") == F.col("h_side")) & (F.col("c") != F.col("h.c")))
    return met.select(F.least("key", "h.key").alias("a"), F.greatest("key", "h.key").alias("b")).distinct()


def group_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b), each once: classes of different components that meet at a place, and there fall into one group.

    A place of up to GROUP classes is one group; larger ones are dealt by a hash, at each place in another way. So the pairs
    grow with the classes, not with their square, and connect most of a crowd of which some pairs only are links.
    """
    sizes = keyed.groupBy("at").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("at", "s_at")
    group = F.pmod(F.xxhash64("key", "at"), F.ceil(F.col("size") / GROUP))
    dealt = keyed.join(sizes, F.col("at") == F.col("s_at")).select("at", group.alias("g"), "side", "key", "c")
    q, m = dealt.alias("q"), dealt.alias("m")
    met = q.join(m, (F.col("q.at") == F.col("m.at")) & (F.col("q.g") == F.col("m.g")) & (F.col("q.side") == -F.col("m.side")) & (F.col("q.c") != F.col("m.c")) & (F.col("q.key") < F.col("m.key")))
    return met.select(F.col("q.key").alias("a"), F.col("m.key").alias("b")).distinct()


def cross_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b), each once: all that meet and are of different components."""
    mixed = _mixed(keyed)
    q, m = mixed.where("c <> hub").alias("q"), mixed.alias("m")
    pairs = q.join(m, (F.col("q.at") == F.col("m.at")) & (F.col("q.side") == -F.col("m.side")) & (F.col("q.c") != F.col("m.c")) & ((F.col("m.c") == F.col("m.hub")) | (F.col("q.key") < F.col("m.key"))))
    return pairs.select(F.least("q.key", "m.key").alias("a"), F.greatest("q.key", "m.key").alias("b")).distinct()


def crowded_places(keyed: DataFrame) -> DataFrame:
    """(at, pivot): places where cross_pairs() would list more than CROWD pairs for each class; pivot: the least class there."""
    mixed = _mixed(keyed)
    counts = [F.count_if(F.expr(f"side = {side}{more}")).alias(name) for name, side, more in (("a", -1, ""), ("b", 0, ""), ("c", 1, ""), ("x", -1, " AND c <> hub"), ("y", 0, " AND c <> hub"), ("z", 1, " AND c <> hub"))]
    sizes = mixed.groupBy("at").agg(F.min("key").alias("pivot"), *counts)
    return sizes.where(f"x * c + y * b + z * a > {CROWD} * (a + b + c)").select("at", "pivot")


def delta_keys(keyed: DataFrame, crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(at, side, key, c) of new places, where classes of different components that meet at a place of crowded and are linked meet too.

    Sets differ from each other by as much as their differences from a third one (that of the place's pivot) do. So what a
    crowd has in common cancels out, and the prefix join is made once more with the differences: two sets linked at the
    threshold differ by a number of shingles that their sizes limit, so their differences have a number in common that the
    counts of these tell, and there is a common one among the rarest. That is done apart for each pair of counts, by steps of
    STEP. Where the counts are so low that nothing need be in common, all of those counts meet at a place of its own.
    sets: (key, n, tokens); keyed has lo and hi, the length classes of its places.
    """
    pivots = sets.select(F.col("key").alias("pivot"), F.col("tokens").alias("ours"))
    met = keyed.join(crowded.join(pivots, "pivot"), "at").join(sets, "key")
    x = met.select("at", "side", "key", "c", "n", "lo", "hi", F.array_union(F.array_except("tokens", "ours"), F.array_except("ours", "tokens")).alias("x"))
    x = x.withColumn("m", F.size("x"))
    theirs = F.when(F.col("side") < 0, F.col("hi")).otherwise(F.col("lo"))
    # sizes up to the top of their length class, at which a linked pair differs most
    differ = F.floor((F.col("n") + F.floor(F.pow(F.lit(CLASS), theirs + 1)) + 1) * (100 - percent) / (100 + percent)).cast("int")
    x = written(x.withColumn("differ", differ), "differences")
    each = x.select("at", "key", "c", F.explode("x").alias("token"))
    known = each.groupBy("at", "token").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("a"), F.max("c").alias("b")).where("df > 1")
    known = known.select(F.col("at").alias("k_at"), F.col("token").alias("t"), "df", (F.col("a") != F.col("b")).alias("mixed"))
    lists = each.join(known, (F.col("at") == F.col("k_at")) & (F.col("token") == F.col("t"))).groupBy("at", "key").agg(F.array_sort(F.collect_list(F.struct("df", "token", "mixed"))).alias("known"))
    lists = x.drop("x").join(lists.withColumnsRenamed({"at": "l_at", "key": "l_key"}), (F.col("at") == F.col("l_at")) & (F.col("key") == F.col("l_key")), "left").withColumn("known", F.coalesce("known", F.array().cast(lists.schema["known"].dataType)))
    # counts that there are on the other side
    there = x.select(F.col("at").alias("t_at"), (-F.col("side")).alias("t_side"), F.floor(F.col("m") / STEP).cast("int").alias("theirs")).distinct()
    lists = lists.withColumn("own", F.floor(F.col("m") / STEP).cast("int")).join(there, (F.col("at") == F.col("t_at")) & (F.col("side") == F.col("t_side")))
    lists = lists.where("theirs * {0} <= m + differ AND theirs * {0} + {0} > m - differ".format(STEP))
    shared = F.ceil((F.col("m") + F.col("theirs") * STEP - F.col("differ")) / 2)
    first = F.greatest(F.size("known") - F.greatest(shared, F.lit(1)) + 1, F.lit(0)).cast("int")
    chosen = F.transform(F.filter(F.slice("known", F.lit(1), first), lambda k: k["mixed"]), lambda k: k["token"])
    chosen = F.when(shared < 1, F.array_append(chosen, F.lit(None).cast("long"))).otherwise(chosen)
    swap = (F.col("side") > 0) | ((F.col("side") == 0) & (F.col("own") > F.col("theirs")))
    side = F.when(F.col("side") == 0, F.signum(F.col("own") - F.col("theirs")).cast("int")).otherwise(F.col("side"))
    out = lists.select("at", F.when(swap, F.col("theirs")).otherwise(F.col("own")).alias("low"), F.when(swap, F.col("own")).otherwise(F.col("theirs")).alias("high"), side.alias("side"), "key", "c", F.explode(chosen).alias("token"))
    out = written(out.select(F.xxhash64("at", "token", "low", "high", F.col("token").isNull()).alias("at"), "side", "key", "c").distinct(), "deltas")
    forget(x)
    return out


def _grouped(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n, key, least id and least key of its component, with that id) of each row of docs; th: hash of the text."""
    n_bands = bands_for(percent / 100)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signer = F.arrow_udf(lambda text: sign(text.cast(pa.binary()).to_pylist(), n_bands), SIGN)
    signed = written(source.select("id", "th", signer("text").alias("s")).select("id", "th", "s.*"), "signed")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "th")).alias("pick"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("top")).where("hub <> top").select("band", "hub")
    members = written(banded.join(shared, "band").select("band", "key", "hub"), "members")
    info = classes.select("key", "n", "sketch")
    wanted = classes.join(members.select(F.col("key").alias("k")).distinct(), F.col("key") == F.col("k"), "left_semi").select("key", F.col("pick.id").alias("w_id"), F.col("pick.th").alias("w_th"))
    texts = source.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("th") == F.col("w_th"))).groupBy("key").agg(F.min("text").alias("text"))
    texts = written(texts, "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
        return written(pairs.join(a, "a").join(b, "b").where(_linked(percent)("ta", "tb")).select("a", "b"), "links")

    def possible(pairs: DataFrame, sketched: DataFrame, samples: int, bits: int) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(sketched.select(F.col("key").alias(x), F.struct("n", "sketch").alias(f"i{x}")), x)
        return pairs.where(_alike("ia", "ib", percent, samples, bits)).select("a", "b")

    pairs = members.where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    links = confirmed(possible(pairs, info, n_bands * ROWS, BITS))

    label = written(components(links), "labels")
    known = members.join(label.withColumnsRenamed({"node": "key", "component": "c"}), "key", "left").select("band", "key", F.coalesce("c", "key").alias("c"))
    open_ = known.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("band")
    known = known.join(open_, "band").select(F.col("key").alias("k"), "c").distinct()
    shingles = F.arrow_udf(lambda text: pa.array([hashed(t).view(np.int64) for t in text.cast(pa.binary()).to_pylist()], pa.list_(pa.int64())), T.ArrayType(T.LongType()))
    tokens = texts.join(known, F.col("key") == F.col("k")).select("key", "c", shingles("text").alias("tokens"))
    tokens = written(tokens.select("key", "c", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "tokens")
    keyed = written(_mixed(prefix_keys(tokens, percent)).drop("hub"), "prefixes")
    finer = F.arrow_udf(lambda text: fine(text.cast(pa.binary()).to_pylist()), T.ArrayType(T.LongType()))
    ends = keyed.select(F.col("key").alias("k")).distinct()
    sharp = texts.join(ends, F.col("key") == F.col("k"), "left_semi").select("key", finer("text").alias("sketch"))
    sharp = written(sharp.join(classes.select("key", "n"), "key"), "sharp")
    # first the least of each place with the others there, and small groups, which connect most of what is alike; then what is still apart
    near_by = confirmed(possible(star_pairs(keyed).union(group_pairs(keyed)).distinct(), sharp, FINE_SAMPLES, FINE_BITS))
    joined = written(components(links.union(near_by)), "labels")
    now = keyed.join(joined, F.col("key") == F.col("node"), "left").select("at", "side", "key", F.coalesce("component", "c").alias("c"), "lo", "hi")
    apart = written(_mixed(now).drop("hub"), "apart")
    crowded = written(crowded_places(apart), "crowded")
    left, deltas = cross_pairs(apart.join(crowded, "at", "left_anti")), []
    if not crowded.isEmpty():
        there = apart.join(crowded, "at", "left_semi").select(F.col("key").alias("k")).distinct()
        sets = texts.join(there, F.col("key") == F.col("k"), "left_semi").select("key", shingles("text").alias("tokens"))
        sets = sets.withColumn("n", F.size("tokens"))
        deltas.append(delta_keys(apart, crowded, sets, percent))
        left = left.union(cross_pairs(deltas[0])).distinct()
    more = confirmed(possible(left, sharp, FINE_SAMPLES, FINE_BITS))

    label = components(links.union(near_by).union(more)).withColumnsRenamed({"node": "k", "component": "c"})
    named = written(classes.select("key", F.col("pick.id").alias("id")).join(label, F.col("key") == F.col("k"), "left").select("key", "id", F.coalesce("c", "key").alias("c")), "named")
    least = named.groupBy("c").agg(F.min(F.struct("id", "key")).alias("least"))
    named = named.join(least.withColumnRenamed("c", "__c"), F.col("c") == F.col("__c")).select(F.col("key").alias("k"), "least")
    out = signed.select("id", "th", "n", "key").join(named, F.col("key") == F.col("k"), "left")
    done = written(out.select("id", "th", "n", "key", F.when(F.col("id").isNotNull(), F.col("least")).alias("least")), "groups")
    forget(signed, classes, members, texts, links, tokens, keyed, sharp, near_by, joined, apart, crowded, *deltas, more)
    return done


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs: components of the links of percent/100 or more.

    Texts with equal shingle sets are one class. Classes that share a band meet in two rounds. First each is compared
    with the smallest of its band only: groups of near copies become stars. Then, in bands whose members are not all
    connected yet, those of different components are compared where the prefix join lets them meet, see prefix_keys(),
    stars and small groups first: every pair that shares a band is thus compared, ruled out or already connected, and neither a dense group's pairs
    nor those of texts that share a template are ever listed. Odd sketches rule pairs out; what they let pass is
    confirmed on the full sets.

    Null and empty texts have no shingles and link with nothing. Rows with a null id are kept, with a null component.
    Rows that repeat an id are judged each by its own text. Other columns are ignored.
    """
    out = _grouped(docs, percent, id_col, text_col)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least.id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component, that of the smallest id (then shingle set, then hash of the text).

    Rows without shingles or without an id stay, all of them. docs' columns stay.
    """
    out = _grouped(docs, percent, id_col, text_col).where("least IS NOT NULL")
    first = (F.col("id") == F.col("least.id")) & (F.col("key") == F.col("least.key"))
    # of rows that agree in id and shingle set the least text stays; of equal rows, one
    chosen = out.where(first).groupBy("id", "key").agg(F.min("th").alias("th"), F.count(F.lit(1)).alias("rows"))
    chosen = written(chosen.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "rows"), "chosen")
    gone = out.select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct().join(chosen, ["__id", "__th"], "left_anti")
    gone = small(written(gone, "gone"), BROADCAST_IDS)
    same = (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    kept = docs.join(gone, same, "left_anti")
    several = chosen.where("rows > 1").drop("rows")
    if several.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")
    once = kept.join(several, same).groupBy("__id", "__th").agg(F.first(row).alias("r")).select("r.*")
    return kept.join(several, same, "left_anti").unionByName(once)


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT reach.v, l.b FROM reach JOIN l ON reach.u = l.a),
c AS (SELECT v, min(u) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""
