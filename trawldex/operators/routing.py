"""Which configured site an address belongs to: the first one that it contains.

All sites are searched for at once by an automaton (Aho-Corasick) that a worker builds from a broadcast list. The list is measured before it is sent; a
longer one than MOST_BYTES goes in several blocks, each within that bound, and the least place in the list counts.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20
PLACE = "struct<place:bigint,site:string>"


def _automaton(sites: list[tuple[int, str]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for place, site in sorted(sites, reverse=True):  # the first place of a site that is listed twice
        found.add_word(site, (place, site))
    found.make_automaton()
    return found


def _first(sent) -> Column:
    """A function of a url: (place, site) of the first site in a broadcast list that the url contains, or null."""

    @F.pandas_udf(PLACE)
    def search(url: pd.Series) -> pd.DataFrame:
        automaton = _built(sent)
        best = [min((hit for _, hit in automaton.iter(u)), default=(None, None)) if u and len(automaton) else (None, None) for u in url]
        return pd.DataFrame({"place": pd.array([p for p, _ in best], "Int64"), "site": [s for _, s in best]})

    return search


_KEPT: dict[int, ahocorasick.Automaton] = {}


def _built(sent) -> ahocorasick.Automaton:
    """One automaton a worker, not one a batch."""
    if sent.id not in _KEPT:
        _KEPT.clear()
        _KEPT[sent.id] = _automaton(sent.value)
    return _KEPT[sent.id]


class _Sent:
    """A broadcast list under a number that workers know it by."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def route(rows: DataFrame, sites: DataFrame, url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows plus routed_to: the first of the sites (place, url) that the url contains, or null. Empty site urls are no sites."""
    spark = rows.sparkSession
    sites = sites.filter("url <> ''").select("place", "url")
    size = sites.agg(F.sum(F.octet_length("url")), F.max(F.octet_length("url"))).first()
    blocks = max(1, -(-2 * (size[0] or 0) // most_bytes)) if (size[0] or 0) > most_bytes else 1
    dealt = sites.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks)))
    places = []
    for b in range(blocks):
        mine = [(r.place, r.url) for r in dealt.filter(F.col("block") == b).collect()]  # no more than fits in the bound
        sent = spark.sparkContext.broadcast(mine)
        places.append(_first(_Sent(sent, sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)))(F.col(url)))
    # structs compare by place first; a block without a hit gives none
    hits = F.array_compact(F.array(*[F.when(p["place"].isNotNull(), p) for p in places]))
    return rows.withColumn("routed_to", F.array_min(hits)["site"])


def listed(spark, urls: list[str]) -> DataFrame:
    """A configured list as a table (place, url)."""
    return spark.createDataFrame(list(enumerate(urls)), "place long, url string")
