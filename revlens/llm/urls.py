"""URL rules in a sorted digest array that tasks map into memory.

Rules are strings: a host, then the begin of a path. Their 64-bit digests are sorted by Spark
and written in segments, each a file of digests, places and strings. A task that judges urls
makes the candidates of each (every parent host with every rule length of path), looks the
digests up by vectorised binary search in the mapped segments, and confirms a hit by the whole
string, so equal digests of different strings do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.shared import fresh, map_arrays, write_arrays
from revlens.session import scratch_path, written_table

ALLOW, BLOCK = "allow", "block"
#: Words that make a host suspect if they are one of the parts between dots and hyphens.
SUSPECT = ("bet", "bets", "casino", "loans", "pills", "poker", "porn", "spam", "warez", "xxx")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Addresses of the segments, their first digests, and the lengths of path that rules have."""

    def __init__(self, segments: list[tuple[int, str]], lengths: list[int]):
        self.first = np.array([s[0] for s in segments], np.int64)
        self.paths, self.lengths, self.open = [s[1] for s in segments], lengths, {}

    def segment(self, k: int) -> dict[str, np.ndarray]:
        if k not in self.open:
            self.open[k] = map_arrays(self.paths[k])
        return self.open[k]

    def look_up(self, digests: np.ndarray, strings: list[str]) -> list[str | None]:
        """The verdict of each string that is a rule, else None."""
        out: list[str | None] = [None] * len(strings)
        order = np.argsort(digests, kind="stable")
        h = digests[order]
        file = np.searchsorted(self.first, h, "right") - 1
        for k in np.unique(file[file >= 0]).tolist():
            arrays, at = self.segment(k), np.flatnonzero(file == k)
            place = np.searchsorted(arrays["digest"], h[at], "left")
            last = np.searchsorted(arrays["digest"], h[at], "right")
            for i in np.flatnonzero(last > place):
                one = int(order[at[i]])
                text = strings[one].encode("utf-8")
                for p in range(int(place[i]), int(last[i])):  # strings of one digest
                    s, e = int(arrays["begin"][p]), int(arrays["begin"][p + 1])
                    if e - s == len(text) and arrays["text"][s:e].tobytes() == text:
                        out[one] = BLOCK if arrays["block"][p] else ALLOW
        return out


def build(rules: DataFrame, segments: int | None = None) -> Rules:
    """Write the array for rules (rule, verdict: allow or block).

    Null and empty rules, and those without a host, are left out; of equal ones allow wins. One row a segment and
    the different lengths of path reach the driver.
    """
    spark = rules.sparkSession
    folder = scratch_path(spark, "rules")
    clean = rules.filter("rule is not null and rule not like '/%' and rule <> ''").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    clean = written_table(clean.select(F.xxhash64("rule").alias("digest"), "rule", "verdict", F.length(path_part(F.col("rule"))).alias("n")), "rules")
    lengths = sorted(r["n"] for r in clean.select("n").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        digest = np.concatenate([b.column("digest").to_numpy() for b in table])
        texts = [t.encode("utf-8") for b in table for t in b.column("rule").to_pylist()]
        block = np.array([v == BLOCK for b in table for v in b.column("verdict").to_pylist()], np.uint8)
        begin = np.append(0, np.cumsum([len(t) for t in texts]))
        path = fresh(folder, "segment")
        write_arrays(path, {"digest": digest, "begin": begin.astype(np.int64), "block": block, "text": np.frombuffer(b"".join(texts), np.uint8)})
        yield pa.RecordBatch.from_pydict({"first": pa.array([int(digest[0])], pa.int64()), "path": [path]})

    parts = clean.repartitionByRange(segments, "digest") if segments else clean.repartitionByRange("digest")
    files = parts.sortWithinPartitions("digest").mapInArrow(run, "first bigint, path string")
    return Rules([tuple(r) for r in written_table(files, "segments").orderBy("first").collect()], lengths)


def path_part(rule: Column) -> Column:
    """What follows the host of a rule."""
    return F.regexp_extract(rule, r"(?s)^[^/?#]*(.*)$", 1)


def judge(pages: DataFrame, rules: Rules, blocked: Rules | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, listed, verdict) of every row.

    The longest rule that fits decides. Where none fits, ``listed`` is the longest fitting entry of
    the array ``blocked`` and its verdict holds; without one the url is allowed. An entry fits its
    host and all subdomains if the path starts with the entry's; of entries of equal length the one
    with the longer host wins. Null urls have empty host and path and fit nothing.
    """
    arrays = [rules, *([blocked] if blocked else [])]
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = F.array(*[F.lit(n) for n in sorted({n for a in arrays for n in a.lengths})]).cast("array<int>")
    lengths = F.filter(known, lambda n: n <= F.length("path"))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    rows = rows.withColumn("strings", F.when(F.col("host") != "", both).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("digests", F.transform("strings", lambda s: F.xxhash64(s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, digests = batch.column("strings"), batch.column("digests").flatten().to_numpy()
            flat = strings.flatten().to_pylist()
            row = np.repeat(np.arange(batch.num_rows), np.diff(strings.offsets.to_numpy()))
            fits = []
            for array in arrays:
                found = array.look_up(digests, flat)
                best: list[str | None] = [None] * batch.num_rows
                verdict: list[str | None] = [None] * batch.num_rows
                for k in [k for k, v in enumerate(found) if v]:
                    r = int(row[k])  # longer hosts come first
                    if best[r] is None or len(flat[k]) > len(best[r]):
                        best[r], verdict[r] = flat[k], found[k]
                fits.append((best, verdict))
            rule, verdict = fits[0]
            listed, second = fits[1] if blocked else ([None] * batch.num_rows, [None] * batch.num_rows)
            listed = [None if r else b for r, b in zip(rule, listed)]
            verdict = [v or s or ALLOW for v, s in zip(verdict, second)]
            cols = [pa.array(x, pa.string()) for x in (rule, listed, verdict)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (id_col, "host", "path")], *cols], names=[id_col, "host", "path", "rule", "listed", "verdict"])

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, listed string, verdict string")


def suspect_hosts(pages: DataFrame, url_col: str = "url", words: tuple[str, ...] = SUSPECT) -> DataFrame:
    """Block rules (rule, verdict) for the hosts of all pages that carry one of the words."""
    host = host_of(F.col(url_col))
    hosts = pages.select(host.alias("host")).filter("host <> ''").distinct()
    hit = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*[F.lit(w) for w in words]))
    return hosts.filter(hit).select(F.concat("host", F.lit("/")).alias("rule"), F.lit(BLOCK).alias("verdict"))
