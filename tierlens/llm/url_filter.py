"""URL filter: a trie over reversed host labels and path segments.

Allow and block entries are (host, path) pairs.  An entry fits its host and every
subdomain when the url's path starts with the entry's path.  Among the entries that
fit, the one with most host labels wins, then the one with the longest path; an entry
listed both ways blocks.  A url that no entry fits gets ``default``.

Null urls and urls without ``://`` have an empty host and path and fit no entry (a
host entry never equals an empty host).  Repeated urls are judged alike; an empty
table gives an empty result; other columns of the table are ignored.

The entries are a short list written by people.  Up to ``MAX_TRIE_ENTRIES`` of them
travel to the tasks as a trie; a longer list is stored as a table and joined with the
host suffixes of the distinct urls, so nothing large is ever broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, pick, stored

MAX_TRIE_ENTRIES = 200_000


def split_path(path: str) -> tuple[list[str], str]:
    """Whole segments (each with its closing slash) and the open rest."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]], parts[-1]


class Trie:
    """Nodes are dicts: host labels from the right, then path segments below ``None``.

    An entry's open rest (the part after its last slash) is kept at its node as a
    prefix that the next characters of a url must have.
    """

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in entries:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            node = node.setdefault("path", {})
            whole, rest = split_path(path)
            for seg in whole:
                node = node.setdefault(("s", seg), {})
            ends = node.setdefault("ends", {})
            if ends.get(rest, ("", ""))[1] != "block":
                ends[rest] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        segs, last = split_path(path)
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            if "path" in node:
                best = self._path(node["path"], segs, last) or best
        return best

    @staticmethod
    def _path(node: dict, segs: list[str], last: str) -> tuple[str, str] | None:
        best = None
        for i in range(len(segs) + 1):
            rest = segs[i] if i < len(segs) else last
            fits = [p for p in node.get("ends", ()) if rest.startswith(p)]
            if fits:
                best = node["ends"][max(fits, key=len)]
            if i == len(segs):
                break
            node = node.get(("s", segs[i]))
            if node is None:
                break
        return best


def parts(url):
    """Host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({u}, instr({u}, '://') + 3)".format(u="url")))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, entries: list[tuple[str, str, str]], default: str = "allow",
               id_col: str = "page_id", url_col: str = "url",
               max_trie: int = MAX_TRIE_ENTRIES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row; ``entries``: (verdict, host, path)."""
    bad = [e for e in entries if e[0] not in ("allow", "block")]
    if bad or default not in ("allow", "block"):
        raise ValueError(f"verdicts are allow and block: {bad or default}")
    host, path = parts(F.col("url"))
    rows = pick(pages, id=id_col, url=url_col)
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    if len(entries) <= max_trie:
        trie = Trie(entries)

        @F.pandas_udf("rule string, verdict string")
        def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            found = [trie.find(h, p) or (None, default) for h, p in zip(host, path)]
            return pd.DataFrame(found, columns=["rule", "verdict"])

        judged = rows.withColumn("v", look_up("host", "path")).select("id", "host", "path", "v.rule", "v.verdict")
    else:
        judged = _joined(rows, entries, default)
    return judged.withColumnRenamed("id", id_col)


def _joined(rows: DataFrame, entries: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same verdicts by a join: distinct (host, path), its host suffixes, the entries."""
    spark = rows.sparkSession
    rules = spark.createDataFrame(entries, "verdict string, rhost string, rpath string").groupBy("rhost", "rpath").agg(
        F.max("verdict").alias("verdict"))
    urls = stored(rows.select("host", "path").distinct(), "urls")
    suffix = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    fits = (urls.select("host", "path", F.explode(suffix).alias("rhost")).join(rules, "rhost")
            .where(F.col("path").startswith(F.col("rpath"))))
    order = F.struct(F.size(F.split("rhost", "[.]")), F.length("rpath"))
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), "verdict"), order).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
