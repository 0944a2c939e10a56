"""Indicators of compromise: every match in a text, and one row per indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def _all(col: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches; texts without ``hint`` are not searched."""
    found = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(col, F.lit(hint)), found).otherwise(none) if hint else found


def _rows(values: Column, step: int, kind: str, tag: str | None = None) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(step).alias("step"), i.alias("i"), F.lit(kind).alias("ioc_type"), v.alias("value"), F.lit(tag).cast("string").alias("tag")))


def matches(content: Column, private: bool = False) -> Column:
    """Array of (step, i, ioc_type, value, tag) in the order of emission; null texts have none."""
    ip4, ip6 = _all(content, fixed.IPV4, "."), _all(content, fixed.IPV6, ":")
    if not private:
        ip4 = F.filter(ip4, lambda v: ~v.rlike(fixed.PRIVATE) & (v != "255.255.255.255"))
    domains = F.filter(_all(content, fixed.DOMAIN, "."), lambda v: ~F.lower(v).isin(*fixed.EXCLUDED_DOMAINS) & ~v.rlike(f"^(?:{fixed.IPV4})") & (F.length(v) >= 4))
    urls = F.transform(_all(content, fixed.URL, "://"), lambda v: F.rtrim(v, F.lit(fixed.URL_TAIL)))
    sha256, sha1, md5 = (F.transform(_all(content, p), F.lower) for p in (fixed.SHA256, fixed.SHA1, fixed.MD5))
    # A hash of one length stands in a longer one only as a part of it: the longer ones as one string, searched once a text.
    longer = F.array_join(sha256, " ")
    sha1 = F.get(F.transform(F.array(longer), lambda told: F.filter(sha1, lambda v: ~F.contains(told, v))), F.lit(0))
    md5 = F.get(F.transform(F.array(F.concat_ws(" ", longer, F.array_join(sha1, " "))), lambda told: F.filter(md5, lambda v: ~F.contains(told, v))), F.lit(0))
    mail = F.filter(F.transform(_all(content, fixed.EMAIL, "@"), F.lower), lambda v: ~v.rlike("(" + "|".join(d.replace(".", r"\.") for d in fixed.EXCLUDED_MAIL) + ")$"))
    return F.concat(
        _rows(ip4, 1, "ip"),
        _rows(F.filter(ip6, lambda v: ~v.isin("::1", "::")), 2, "ip"),
        _rows(domains, 3, "domain"),
        _rows(urls, 4, "url"),
        _rows(sha256, 5, "hash", "sha256"),
        _rows(sha1, 6, "hash", "sha1"),
        _rows(md5, 7, "hash", "md5"),
        _rows(mail, 8, "email"),
    )


def of_visits(url: Column, title: Column) -> Column:
    """What a browser record tells beside its text: its whole URL, and the host if it is a valid domain."""
    host = text.netloc(url)
    valid = ~F.lower(host).isin(*fixed.EXCLUDED_DOMAINS) & ~host.rlike(f"^(?:{fixed.IPV4})") & (F.length(host) >= 4)
    rows = F.array(
        F.when(url != "", F.struct(F.lit(9).alias("step"), F.lit(0).alias("i"), F.lit("url").alias("ioc_type"), url.alias("value"), F.lit("browser_history").alias("tag"), title.alias("context"))),
        F.when((host != "") & valid, F.struct(F.lit(9).alias("step"), F.lit(1).alias("i"), F.lit("domain").alias("ioc_type"), host.alias("value"), F.lit("browser_history").alias("tag"), title.alias("context"))),
    )
    return F.filter(rows, lambda x: x.isNotNull())


def of_events(address: Column, event_id: Column) -> Column:
    """The address of an event log record, whatever its form, unless private; logons are tagged."""
    public = (address != "") & ~address.rlike(fixed.PRIVATE) & (address != "255.255.255.255")
    tag = F.when(event_id.isin(4624, 4625), "network_logon").alias("tag")
    row = F.struct(F.lit(10).alias("step"), F.lit(0).alias("i"), F.lit("ip").alias("ioc_type"), address.alias("value"), tag, F.concat(F.lit("EventID:"), event_id.cast("string")).alias("context"))
    return F.filter(F.array(F.when(public, row)), lambda x: x.isNotNull())


def ranked(found: DataFrame, most: int | None = None) -> DataFrame:
    """Deduplicated indicators, the most frequent first, of equals the one seen first; with ``most`` a top-k."""
    out = found.orderBy(F.desc("occurrence_count"), "first_ord")
    return out.limit(most) if most else out


def occurrences(records: DataFrame, key: str, content: str, private: bool = False, source: str = "text") -> DataFrame:
    """(ord, source, ioc_type, value, tag) per match; ``key`` orders the records."""
    found = records.select(F.col(key).alias("ord_key"), F.explode(matches(F.col(content), private)).alias("m"))
    return found.select(F.struct("ord_key", "m.step", "m.i").alias("ord"), F.lit(source).alias("source"), "m.ioc_type", "m.value", "m.tag")


def deduplicate(found: DataFrame, kind: str | None = None, least: int = 1) -> DataFrame:
    """One row per lower-cased value: how often, and the first spelling and type.

    All aggregates have partial forms of fixed size, so a value that every record
    holds costs one row per task in the shuffle. Sources and tags are few by nature.
    """
    out = found.groupBy(F.lower("value").alias("ioc_key")).agg(
        F.count("*").alias("occurrence_count"),
        F.min_by(F.struct("ioc_type", "value"), "ord").alias("first"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("tag")).alias("tags"),
        F.min("ord").alias("first_ord"),
    )
    out = out.select("ioc_key", "first.ioc_type", "first.value", text.defang(F.col("first.value"), F.col("first.ioc_type")).alias("defanged"), "occurrence_count", "sources", "tags", "first_ord")
    if kind:
        out = out.where(F.col("ioc_type") == kind)
    return out.where(F.col("occurrence_count") >= least) if least > 1 else out
