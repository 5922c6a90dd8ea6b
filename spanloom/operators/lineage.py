"""Cross-layer lineage: endpoint -> service -> controller -> route -> client call -> UI, as joins on normalised paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import durable
from . import paths

_PARAM = r"^(:.*|\{.*\}|\$.*)$"


def strict_key(path: Column) -> Column:
    """What strictly equal paths share: no query, single slashes, none at the end, each parameter as {}."""
    cut = F.regexp_replace(F.regexp_replace(F.substring_index(path, "?", 1), "/+", "/"), "(?<=.)/$", "")
    return F.array_join(F.transform(F.split(cut, "/"), lambda s: F.when(s.rlike(_PARAM), "{}").otherwise(s)), "/")


def match_paths_strict(a: DataFrame, b: DataFrame, a_path: str, b_path: str, how: str = "inner") -> DataFrame:
    """a joined to b where the paths are equal, parameter to parameter."""
    return a.withColumn("_key", strict_key(F.col(a_path))).join(b.withColumn("_key", strict_key(F.col(b_path))), "_key", how).drop("_key")


def wild_segments(path: Column) -> Column:
    """Segments, lower-cased, without a leading /api; parameters as *."""
    low = F.regexp_replace(F.lower(F.substring_index(path, "?", 1)), "^/api/", "/")
    return F.transform(F.filter(F.split(low, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(_PARAM), "*").otherwise(s))


def match_paths_wild(a: DataFrame, b: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a joined to b where each segment is equal or a parameter on either side: a's different paths walk a trie of b's."""
    y = durable(b.withColumn("_b", wild_segments(F.col(b_path))).withColumn("end", paths.ends(F.col("_b"))))
    edges, deepest = paths.trie(y, "_b")
    x = a.withColumn("_a", wild_segments(F.col(a_path)))
    found = paths.walk(x.select("_a").distinct(), "_a", edges, deepest)
    return x.join(found, "_a").join(y.drop("_b"), "end").drop("_a", "end")


def normalise_service_path(raw: Column) -> Column:
    """Without the base-url variable and the query, one slash in front."""
    bare = F.regexp_replace(F.substring_index(raw, "?", 1), r"^\$?\{[^}]*\}", "")
    return F.concat(F.lit("/"), F.regexp_replace(bare, "^/+", ""))


def normalise_client_url(raw: Column) -> Column:
    """As a service path, under /api."""
    path = normalise_service_path(raw)
    return F.when(path.rlike("^/api(/|$)"), path).otherwise(F.concat(F.lit("/api"), path))


def dedup_ui_usage(ui: DataFrame) -> DataFrame:
    """One row per (app, component, api_func, line), the first by file."""
    first = F.row_number().over(W.partitionBy("app", "component", "api_func", "line").orderBy("file"))
    return ui.withColumn("_n", first).filter("_n = 1").drop("_n")


def route_clients(routes: DataFrame, apis: DataFrame) -> DataFrame:
    """(full_path, sub_path, app, api_func, url, raw_url): clients of each route, by their url or by their raw url and its sub-path.

    Either way is a join on equal keys; a client that both find is one row.
    """
    known = routes.select("full_path", "sub_path").distinct()
    by_url = match_paths_strict(known, apis, "full_path", "url")
    by_part = match_paths_strict(known, apis, "sub_path", "raw_url")
    return by_url.unionByName(by_part).distinct()


def lineage_chains(endpoints: DataFrame, services: DataFrame, controllers: DataFrame, routes: DataFrame, apis: DataFrame, ui: DataFrame) -> DataFrame:
    """The chains of every endpoint, one row for each way up; methods are not compared, and what is missing is null."""
    s = match_paths_strict(endpoints, services.select("service_func", F.col("raw_path").alias("_p")), "path", "_p", "left").drop("_p")
    c = s.join(controllers, "service_func", "left").join(routes, "controller_func", "left")
    a = route_clients(routes, apis).drop("url", "raw_url")
    out = c.join(a, ["full_path", "sub_path"], "left").join(ui, ["app", "api_func"], "left")
    return out.select("id", "path", "method", "handler", "service_func", "controller_func", "full_path", "app", "api_func", "component", "caller")


def chain_status(endpoints: DataFrame, services: DataFrame, controllers: DataFrame, routes: DataFrame, apis: DataFrame, ui: DataFrame) -> DataFrame:
    """Per endpoint (id, path, method): furthest status, services, routes, clients and usages on its ways up, and the client apps.

    Counted from the top down before anything is joined to endpoints: usages of a client, clients of a route, routes of a
    controller, controllers of a service, services of a path. No chain is made; each is counted as often as it stands.
    """
    zero = lambda *c: [F.coalesce(x, F.lit(0)).alias(x) for x in c]
    apps = lambda c="app": F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias("apps")
    used = ui.groupBy("app", "api_func").agg(F.count("*").alias("usages"))
    of_route = route_clients(routes, apis).join(used, ["app", "api_func"], "left").groupBy("full_path", "sub_path").agg(F.count("*").alias("clients"), F.coalesce(F.sum("usages"), F.lit(0)).alias("usages"), F.collect_set("app").alias("apps"))
    sums = [F.sum(c).alias(c) for c in ("clients", "usages")]
    of_controller = routes.join(of_route, ["full_path", "sub_path"], "left").groupBy("controller_func").agg(F.count("*").alias("routes"), *sums, apps("apps"))
    of_service = controllers.join(of_controller, "controller_func", "left").groupBy("service_func").agg(F.count("*").alias("bridges"), F.sum("routes").alias("routes"), *sums, apps("apps"))
    of_path = services.join(of_service, "service_func", "left").groupBy(strict_key(F.col("raw_path")).alias("_key")).agg(F.sum(F.coalesce("bridges", F.lit(1))).alias("services"), F.sum("routes").alias("routes"), *sums, apps("apps"))
    per = endpoints.withColumn("_key", strict_key(F.col("path"))).join(of_path, "_key", "left").select("id", "path", "method", *zero("services", "routes", "clients", "usages"), F.coalesce("apps", F.array().cast("array<string>")).alias("apps"))
    status = F.when(F.col("usages") > 0, "full_chain").when(F.col("clients") > 0, "client_api").when(F.col("routes") > 0, "backend_exposed").when(F.col("services") > 0, "service_only").otherwise("unexposed")
    return per.withColumn("status", status)


def lineage_summary(status: DataFrame) -> DataFrame:
    """(measure, n) of chain_status: endpoints per status, and endpoints that each client app reaches."""
    by_status = status.groupBy(F.col("status").alias("measure")).agg(F.count("*").alias("n"))
    by_app = status.select(F.explode("apps").alias("app")).groupBy(F.concat(F.lit("from "), "app").alias("measure")).agg(F.count("*").alias("n"))
    return by_status.union(by_app)


def filter_chains(chains: DataFrame, statuses: DataFrame, query: str = "", status: str | None = None, domain: str | None = None, app: str | None = None) -> DataFrame:
    """chain_status rows of endpoints whose lineage_chains hold the text anywhere; domain is the first path segment, or root."""
    first = F.regexp_extract("path", "^/([^/]+)", 1)
    out = chains.withColumn("domain", F.when(first == "", "root").otherwise(first))
    keep = F.lit(True)
    if query.strip():
        columns = ("id", "path", "method", "domain", "handler", "service_func", "controller_func", "full_path", "component", "caller")
        keep = F.exists(F.array(*columns), lambda x: F.coalesce(F.contains(F.lower(x), F.lit(query.strip().lower())), F.lit(False)))
    if domain:
        keep = keep & (F.col("domain") == domain)
    if app:
        keep = keep & (F.col("app") == app)
    found = statuses.join(out.filter(keep).select("id").distinct(), "id", "left_semi")
    return found.filter(F.col("status") == status) if status else found
