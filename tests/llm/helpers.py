"""Plain versions of the contracts, one document at a time, and frames to run the operators on."""

import collections
import re
import zlib

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like those that the operators make.
CLASHING = DOCS + ", locator string, digest int, kept int, row string, score string, fp int, uid int, hash int, n int"


def frame(spark, rows, clashing=False):
    """rows: (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
    if clashing:
        return spark.createDataFrame([(*r, "x", 1, 1, "r", "s", 1, 1, 1, 1) for r in full], CLASHING)
    return spark.createDataFrame(full, DOCS)


def saved(spark, tmp_path, **tables):
    """A folder like the driver's with the given frames."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in SPACE.split(ascii_lower(text)) if w]


def normalised(text):
    return SPACE.sub(" ", text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(items, linked):
    """{item: smallest item reachable} by comparing all pairs."""
    items = sorted(items)
    parent = {i: i for i in items}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(items):
        for b in items[:n]:
            if linked(a, b):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in items}


def shingles5(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def least_sequences(lengths, capacity):
    """The least number of sequences, by trying all ways (few lengths)."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(order):
            best[0] = len(bins)
            return
        tried = set()
        for b, used in enumerate(bins):
            if used + order[i] <= capacity and used not in tried:
                tried.add(used)
                bins[b] += order[i]
                go(i + 1, bins)
                bins[b] -= order[i]
        bins.append(order[i])
        go(i + 1, bins)
        bins.pop()

    if order:
        go(0, [])
    return best[0]


def check_packing(rows, capacity=4096):
    """Sequences are gapless and not too long; returns how many there are."""
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def executed_with_small_thresholds(spark, df):
    """The plan that ``df`` ran with, where Spark takes little for a skewed partition. ``df`` is made anew in a session of its own settings."""
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        again = df.select("*")
        again.collect()
        return again._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
