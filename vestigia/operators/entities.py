"""Users, hosts, networks, processes, files, domains and services that records name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import basename, netloc


def _entity(kind: str, id_: Column, name: Column, when: Column, tags: tuple[str, ...] = (), related: Column | None = None, **attributes: Column) -> Column:
    attrs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
    return F.when(
        when,
        F.struct(
            F.concat(F.lit(f"{kind}:"), id_).alias("entity_id"),
            F.lit(kind).alias("entity_type"),
            name.alias("name"),
            (F.create_map(*attrs) if attrs else F.create_map().cast("map<string,string>")).alias("attributes"),
            F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"),
            F.coalesce(related, F.lit(None).cast("string")).alias("related") if related is not None else F.lit(None).cast("string").alias("related"),
        ),
    )


def _named(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def _user(name: Column, domain: Column, sid: Column) -> Column:
    id_ = F.lower(F.concat(F.coalesce(domain, F.lit("")), F.lit("\\"), name))
    return _entity("user", id_, name, _named(name) & ~name.isin(*fixed.NO_USER), domain=domain, sid=sid)


def of_event_log(r: dict[str, Column]) -> list[Column]:
    """Emissions of an event log record from its columns, in order; missing columns are null."""
    get = lambda k: r.get(k, F.lit(None).cast("string"))
    subject, address, process = F.coalesce(get("subject_user_name"), get("user")), F.coalesce(get("ip_address"), get("source_network_address")), F.coalesce(get("process_name"), get("new_process_name"))
    return [
        _user(subject, get("subject_domain_name"), get("subject_user_sid")),
        _user(get("target_user_name"), get("target_domain_name"), get("target_user_sid")),
        _entity("host", F.lower(get("workstation_name")), get("workstation_name"), _named(get("workstation_name")) & (get("workstation_name") != "-")),
        _entity("network", address, address, address.isNotNull() & ~address.isin(*fixed.NO_ADDRESS), port=get("ip_port")),
        _entity("process", F.lower(basename(process)), basename(process), _named(process), full_path=process),
    ]


def of_url(url: Column) -> list[Column]:
    return [_entity("domain", F.lower(netloc(url)), netloc(url), netloc(url) != "", ("visited",), scheme=F.regexp_extract(url, "^([^:]+):", 1))]


def of_file(path: Column, sha1: Column, size: Column) -> list[Column]:
    """A cached program: the file, and the process that points to it."""
    return [
        _entity("file", F.lower(path), path, _named(path), full_path=path, sha1=sha1, size=size),
        _entity("process", F.lower(basename(path)), basename(path), _named(path), ("executed",), F.concat(F.lit("file:"), F.lower(path)), full_path=path),
    ]


def of_service(name: Column, image: Column, start_type: Column) -> list[Column]:
    return [
        _entity("service", F.lower(name), name, _named(name), image_path=image, start_type=start_type),
        _entity("file", F.lower(image), image, _named(image), (), F.concat(F.lit("service:"), F.lower(name)), full_path=image),
    ]


def emit(records: DataFrame, key: str, timestamp: str, source: str, emissions: list[Column]) -> DataFrame:
    """(ord, timestamp, source, entity_id, entity_type, name, attributes, tags, related) per emission."""
    rows = records.select(F.col(key).alias("k"), F.col(timestamp).cast("timestamp").alias("timestamp"), F.posexplode(F.array(*emissions)).alias("pos", "e"))
    return rows.where("e is not null").select(F.struct("k", "pos").alias("ord"), "timestamp", F.lit(source).alias("source"), "e.*")


def deduplicate(found: DataFrame, kind: str | None = None, least: int = 1) -> DataFrame:
    """One row per entity id: count, first and last time, first name, last value per attribute.

    Attributes are reduced per entity and key before they are put into a map, so an
    entity that most records name never gathers its rows in one task.
    """
    base = found.groupBy("entity_id").agg(
        F.count("*").alias("occurrence_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min_by(F.struct("entity_type", "name"), "ord").alias("first"),
        F.min("ord").alias("first_ord"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    attributes = (
        found.select("entity_id", "ord", F.explode("attributes").alias("k", "v"))
        .groupBy("entity_id", "k")
        .agg(F.max_by("v", "ord").alias("v"))
        .groupBy("entity_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    )
    out = base.join(attributes, "entity_id", "left").select("entity_id", "first.entity_type", "first.name", "occurrence_count", "first_seen", "last_seen", "sources", "attributes", "first_ord")
    if kind:
        out = out.where(F.col("entity_type") == kind)
    return out.where(F.col("occurrence_count") >= least) if least > 1 else out


def edges(found: DataFrame) -> DataFrame:
    """Distinct (entity_id, related) links."""
    return found.where("related is not null").groupBy("entity_id", "related").agg(F.count("*").alias("n"))
