"""Event batches, the event log, source corpora and nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "kind string, request_id string, span_id string, parent_span_id string, seq long, ts double, depth int, data struct<method:string,path:string,status:int,duration_ms:long,span_count:int,route:string,handler:string,name:string,qualname:string,module:string,file:string,line:string,args:map<string,string>,args_truncated:boolean,captured:boolean,result:string,result_truncated:boolean,exc_type:string,message:string,traceback:string,label:string,model:string,level:string,parsed:string>"
BATCH = f"kind string, dropped long, brain_base_url string, started_at string, code_fingerprint string, events array<struct<{', '.join(f'{c.split(" ", 1)[0]}:{c.split(" ", 1)[1]}' for c in EVENT.split(', '))}>>"
#: Folders that hold no project source.
IGNORED = ("__pycache__", "node_modules", "venv", "env", "site-packages", "build", "dist")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches as sent, one row each; whatever doesn't parse is null."""
    return spark.read.schema(BATCH).json(path)


def events_of(batches: DataFrame) -> DataFrame:
    """One flat row per event; register payloads and missing event lists give none."""
    rows = batches.filter(F.coalesce("kind", F.lit("events")) != "register").select(F.explode("events").alias("e")).select("e.*")
    return rows.select("kind", "request_id", "span_id", "parent_span_id", "seq", "ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("ts_event"), "depth", "data.*")


def registers_of(batches: DataFrame) -> DataFrame:
    return batches.filter("kind = 'register'").select("brain_base_url", "started_at", "code_fingerprint")


def ingest_counters(batches: DataFrame) -> DataFrame:
    """(events_in, dropped, registers)."""
    n = F.greatest(F.size("events"), F.lit(0))
    return batches.agg(F.coalesce(F.sum(F.when(F.col("events").isNotNull(), n)), F.lit(0)).alias("events_in"), F.coalesce(F.sum(F.coalesce("dropped", F.lit(0))), F.lit(0)).alias("dropped"), F.count_if(F.col("kind") == "register").alias("registers"))


def write_event_log(ev: DataFrame, path: str, mode: str = "append") -> None:
    """Append events to the log, in one folder per day of their timestamp."""
    ev.withColumn("date", F.to_date("ts")).repartition("date", F.pmod(F.xxhash64("request_id"), F.lit(16))).sortWithinPartitions("seq").write.partitionBy("date").mode(mode).parquet(path)


def replay(spark: SparkSession, path: str, since_seq: int | None = None, request_id: str | None = None) -> DataFrame:
    """Everything stored, in order of seq; the filters reach the scan."""
    log = spark.read.parquet(path)
    log = log if since_seq is None else log.filter(F.col("seq") >= since_seq)
    log = log if request_id is None else log.filter(F.col("request_id") == request_id)
    return log.orderBy("seq", "kind")


def read_source_corpus(spark: SparkSession, root: str, ignore: Sequence[str] = IGNORED) -> DataFrame:
    """(path below root, content, mtime, size) of .py files, none of whose folders is hidden or ignored; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    named = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return source_files(named, ignore)


def source_files(files: DataFrame, ignore: Sequence[str] = IGNORED) -> DataFrame:
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return files.filter(F.col("path").endswith(".py") & ~F.exists(folders, lambda d: d.startswith(".") | d.isin(*ignore)))


TEMPLATES = "version int, project string, templates array<struct<id:string,name:string,functions:array<struct<id:string,deep:boolean>>>>"


def read_templates(documents: DataFrame, version: int, project: str, json_col: str = "json") -> DataFrame:
    """(template_id, name, functions) out of JSON documents; those of another version or project are ignored."""
    d = documents.select(F.from_json(json_col, TEMPLATES).alias("d")).filter((F.col("d.version") == version) & (F.col("d.project") == project))
    return d.select(F.inline("d.templates")).withColumnRenamed("id", "template_id")


_ROUTE = "struct<method:string,fullPath:string,subPath:string>"
_BACKEND = f"struct<service:struct<serviceFunc:string,rawPath:string,method:string>,controller:struct<controllerFunc:string>,routes:array<{_ROUTE}>>"
_CLIENT = "struct<app:string,api:struct<apiFunc:string,url:string,rawUrl:string>,ui:array<struct<component:string,callerFunc:string>>>"
CHAINS = f"version int, project_path string, chains array<struct<id:string,method:string,path:string,domain:string,status:string,endpoint:struct<handler_id:string>,backend:array<{_BACKEND}>,clients:array<{_CLIENT}>>>"


def read_lineage_chains(documents: DataFrame, version: int, project: str, json_col: str = "json") -> DataFrame:
    """(id, method, path, domain, status, handler, backend, clients): the chains of JSON documents of this version and project."""
    d = documents.select(F.from_json(json_col, CHAINS).alias("d")).filter((F.col("d.version") == version) & (F.col("d.project_path") == project))
    return d.select(F.inline("d.chains")).select("id", "method", "path", "domain", "status", F.col("endpoint.handler_id").alias("handler"), "backend", "clients")


def backend_of(chains: DataFrame) -> DataFrame:
    """(id, service_func, raw_path, controller_func, route_method, full_path, sub_path): a row for each way into the backend, with nulls where it ends early."""
    rows = chains.select("id", F.inline("backend")).select("id", F.col("service.serviceFunc").alias("service_func"), F.col("service.rawPath").alias("raw_path"), F.col("controller.controllerFunc").alias("controller_func"), F.explode_outer("routes").alias("r"))
    return rows.select("id", "service_func", "raw_path", "controller_func", F.col("r.method").alias("route_method"), F.col("r.fullPath").alias("full_path"), F.col("r.subPath").alias("sub_path"))


def clients_of(chains: DataFrame) -> DataFrame:
    """(id, app, api_func, url, raw_url, component, caller): a row for each use of a client, with nulls where nothing uses it."""
    rows = chains.select("id", F.inline("clients")).select("id", "app", F.col("api.apiFunc").alias("api_func"), F.col("api.url").alias("url"), F.col("api.rawUrl").alias("raw_url"), F.explode_outer("ui").alias("u"))
    return rows.select("id", "app", "api_func", "url", "raw_url", F.col("u.component").alias("component"), F.col("u.callerFunc").alias("caller"))
