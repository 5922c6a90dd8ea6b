"""Source corpus -> catalogue: per-file jobs without a shuffle, then joins."""

from __future__ import annotations

import builtins
import difflib
import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pysource
from ..functions.tables import durable

#: Module heads that are no source.
NON_SOURCE = ("tests", "test", "scripts", "migrations", "alembic", "docs", "conftest")
#: Callees that say nothing: the language's own names.
BUILTINS = sorted(n for n in dir(builtins) if not n.startswith("_"))
#: Methods of common values (text, lists, maps, loggers, models, patterns), no calls of the project.
NOISE_ATTRS = tuple(
    "join split rsplit strip lstrip rstrip format lower upper startswith endswith replace encode decode title capitalize splitlines partition casefold "
    "append extend insert pop remove clear copy get items keys values update setdefault add discard sort reverse index count union intersection "
    "difference popitem fromkeys isupper islower isdigit isalpha isalnum isspace find rfind zfill ljust rjust center swapcase removeprefix "
    "removesuffix isnumeric isidentifier translate expandtabs debug info warning warn error exception critical log model_dump model_dump_json "
    "model_validate model_copy dict json group groups groupdict match search fullmatch findall finditer sub subn".split()
)


def _per_file(files: DataFrame, rows: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in _split_schema(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [r for p, c in zip(pdf["path"], pdf["content"]) for r in rows(p, c or "")]
            yield pd.DataFrame(found, columns=names)

    # a small file may name or make very many sources: they are dealt over tasks, however few the input has
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", F.col("content").cast("string").alias("content")).repartition(tasks, "path").mapInPandas(run, schema)


def _split_schema(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def scan_functions(files: DataFrame) -> DataFrame:
    """files (path, content) -> one row per function, class, method or unreadable file, with its module and id."""
    param = "array<struct<name:string,annotation:string,default:string,kind:string,required:boolean>>"
    found = _per_file(files, pysource.functions, f"path string, kind string, class_name string, name string, qualname string, line int, end_line int, params {param}, decorators array<string>, is_async boolean, doc string")
    return function_ids(found.withColumn("module", module_name(F.col("path"))))


def module_name(path: Column) -> Column:
    """a/b/__init__.py -> a.b, a/b.py -> a.b."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))


def function_ids(functions: DataFrame) -> DataFrame:
    """With function_id (hash of the dotted name) and catalogue_id (module:QualName)."""
    return functions.withColumns({"function_id": F.substring(F.sha1(F.concat_ws(".", "module", "qualname")), 1, 16), "catalogue_id": F.concat_ws(":", "module", "qualname")})


def catalogue(functions: DataFrame) -> DataFrame:
    """(package, id, name, signature, doc, is_async, path, line): functions and methods of source modules.

    Rows, not an array per package: a package may hold any number; group and sort downstream where it is known to be small.
    """
    head = F.substring_index("module", ".", 1)
    shown = F.filter(F.col("params.name"), lambda p: ~p.isin("self", "cls"))
    doc = F.substring(F.element_at(F.split(F.trim(F.coalesce("doc", F.lit(""))), "\n"), 1), 1, 200)
    kept = functions.filter(F.col("kind").isin("function", "method") & ~head.isin(*NON_SOURCE))
    return kept.select(F.array_join(F.slice(F.split("module", r"\."), 1, 3), ".").alias("package"), F.col("catalogue_id").alias("id"), F.col("qualname").alias("name"), F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")")).alias("signature"), doc.alias("doc"), "is_async", "path", "line")


def search_catalogue(cat: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """The first `limit` hits in order of package and id, each with total_matches."""
    q = query.strip().lower()
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(q)) for c in ("id", "name", "signature", "doc")])
    hits = cat.filter(hit)
    total = hits.agg(F.count("*").alias("total_matches"))
    return hits.orderBy("package", "id").limit(limit).crossJoin(F.broadcast(total))  # one row


def close_matches(missing: DataFrame, known: DataFrame, n: int = 3, cutoff: float = 0.5, exact: bool = False) -> DataFrame:
    """(word, match, ratio, rank): the n most alike known ids, by Ratcliff-Obershelp ratio of at least cutoff; the larger id first on ties.

    Pairs come from shared trigrams, inside the lengths that the cutoff allows; `exact` regards all ids (see _best_of_all).
    """
    m, k = (df.select(F.col("id").alias(c)).dropna().distinct() for df, c in ((missing, "word"), (known, "match")))
    if exact:
        scored = _best_of_all(durable(m), durable(k), n, cutoff)
    else:
        grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))
        shared = m.withColumn("_g", grams(F.col("word"))).join(k.withColumn("_g", grams(F.col("match"))), "_g")
        a, b = F.length("word"), F.length("match")
        pairs = shared.select("word", "match").distinct().filter(2 * F.least(a, b) >= cutoff * (a + b))

        @F.pandas_udf("double")
        def ratio(word: pd.Series, match: pd.Series) -> pd.Series:
            alike, out = difflib.SequenceMatcher(), []
            for x, y in zip(word, match):
                if alike.b != x:
                    alike.set_seq2(x)  # what is known of the word serves all its pairs
                alike.set_seq1(y)
                out.append(alike.ratio() if alike.real_quick_ratio() >= cutoff and alike.quick_ratio() >= cutoff else 0.0)
            return pd.Series(out, dtype=float)

        scored = pairs.withColumn("ratio", ratio("word", "match")).filter(F.col("ratio") >= cutoff)
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.desc("ratio"), F.desc("match")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


#: Characters are counted by their code points modulo this; ids and words that one task compares.
_BINS, _BLOCK_IDS, _BLOCK_WORDS = 128, 20_000, 2_000


def _bins(text: str) -> np.ndarray:
    return np.bincount(np.fromiter(map(ord, text), np.int64, len(text)) % _BINS, minlength=_BINS)


def _best_of_all(words: DataFrame, known: DataFrame, n: int, cutoff: float) -> DataFrame:
    """(word, match, ratio): the n best ids of each word in each block of ids, every id regarded.

    A ratio is never above that of the characters two texts share in any order; ids are tried in falling order of that bound, which
    is counted for a whole block at once, until it is below the n-th ratio found.
    """
    blocks = 1 + known.count() // _BLOCK_IDS
    count = words.count()
    parts = max(1 + count // _BLOCK_WORDS, min(1 + count // 20, 4 * words.sparkSession.sparkContext.defaultParallelism))
    number = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    asked = words.select("word", number("word", parts).alias("part"), every(blocks).alias("block"))
    ids = known.select("match", number("match", blocks).alias("block"), every(parts).alias("part"))

    def best(asked: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        texts, out, alike = list(ids["match"]), [], difflib.SequenceMatcher()
        counts = np.array([_bins(x) for x in texts], np.int32).reshape(-1, _BINS).T.copy()
        lengths = np.array([len(x) for x in texts])
        for word in asked["word"] if texts else ():
            own = _bins(word)
            some = np.flatnonzero(own)
            both = np.maximum(lengths + len(word), 1)
            shared = np.minimum(counts[some], own[some, None].astype(np.int32)).sum(axis=0)
            bound = np.where(lengths + len(word) == 0, 1.0, 2.0 * shared / both)
            hope = np.flatnonzero(bound >= cutoff)
            alike.set_seq2(word)
            top = []
            for i in hope[np.argsort(-bound[hope], kind="stable")]:
                if len(top) == n and bound[i] < top[0][0]:
                    break
                alike.set_seq1(texts[i])
                found = (alike.ratio(), texts[i])
                if found[0] >= cutoff:
                    (heapq.heappush if len(top) < n else heapq.heappushpop)(top, found)
            out += [(word, match, ratio) for ratio, match in top]
        return pd.DataFrame(out, columns=["word", "match", "ratio"])

    keys = ("part", "block")
    return asked.groupBy(*keys).cogroup(ids.groupBy(*keys)).applyInPandas(best, "word string, match string, ratio double")


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """(files, mark, total): changes when any (path, mtime, size) does, in any order of files."""
    h = F.xxhash64("path", "mtime", "size")
    return files.agg(F.count("*").alias("files"), F.bit_xor(h).alias("mark"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))


def run_vs_disk(files: DataFrame, started_at: str | None, grace_seconds: float = 2.0) -> DataFrame:
    """(state, newer_files, newest_file): whether code under app/ (or anywhere, without an app/) changed after the start."""
    start = F.try_to_timestamp(F.lit(started_at))
    py = files.filter(F.col("path").endswith(".py"))
    app = F.col("path").startswith("app/")
    newer = F.unix_micros(F.col("mtime").cast("timestamp")) > F.unix_micros(start) + F.lit(int(grace_seconds * 1e6))
    counts = lambda c: (F.count_if(newer & c), F.max_by("path", F.when(newer & c, F.struct("mtime", "path"))))
    (n_app, last_app), (n_all, last_all) = counts(app), counts(F.lit(True))
    one = py.agg(F.max(app).alias("has_app"), n_app.alias("na"), last_app.alias("la"), n_all.alias("n"), last_all.alias("l"))
    n = F.when(start.isNull(), 0).when(F.col("has_app"), F.col("na")).otherwise(F.col("n"))
    state = F.when(start.isNull(), "unknown").when(n > 0, "older").otherwise("current")
    return one.select(state.alias("state"), n.cast("long").alias("newer_files"), F.when(n > 0, F.when(F.col("has_app"), F.col("la")).otherwise(F.col("l"))).alias("newest_file"))


def scan_imports(files: DataFrame) -> DataFrame:
    return _per_file(files, pysource.imports, "path string, module string, alias string, target_module string, target_attr string")


def scan_names(files: DataFrame) -> DataFrame:
    return _per_file(files, pysource.top_names, "module string, name string").distinct()


def resolve_imports(imports: DataFrame, names: DataFrame, hops: int = 8) -> DataFrame:
    """imports with found_module and found_name: where each really lands, through re-exports; null if outside the corpus."""
    names = durable(names)
    links = durable(imports.select("module", "alias", "target_module", "target_attr").distinct())
    modules = names.filter("name IS NULL").select(F.col("module").alias("_m"), F.lit(True).alias("_is"))
    defined = names.filter("name IS NOT NULL").select(F.col("module").alias("_m"), F.col("name").alias("_a")).join(links.select(F.col("module").alias("_m"), F.col("alias").alias("_a")), ["_m", "_a"], "left_anti").withColumn("_def", F.lit(True))
    onward = links.select(F.col("module").alias("_m"), F.col("alias").alias("_a"), F.col("target_module").alias("_m2"), F.col("target_attr").alias("_a2"))
    subs = modules.select(F.col("_m").alias("_sub"), F.lit(True).alias("_issub"))
    state = durable(links.select("module", "alias", F.col("target_module").alias("_m"), F.col("target_attr").alias("_a")))
    done = []
    for _ in range(hops + 1):
        at = state.join(modules, "_m", "left").join(defined, ["_m", "_a"], "left").join(onward, ["_m", "_a"], "left").withColumn("_sub", F.concat_ws(".", "_m", "_a")).join(subs, "_sub", "left").filter("_is")
        at = durable(at)
        done.append(at.filter("_a IS NULL").select("module", "alias", F.col("_m").alias("found_module"), F.lit(None).cast("string").alias("found_name")))
        done.append(at.filter("_def").select("module", "alias", F.col("_m").alias("found_module"), F.col("_a").alias("found_name")))
        rest = at.filter("_a IS NOT NULL AND _def IS NULL")
        done.append(rest.filter("_m2 IS NULL AND _issub").select("module", "alias", F.col("_sub").alias("found_module"), F.lit(None).cast("string")))
        state = durable(rest.filter("_m2 IS NOT NULL").select("module", "alias", F.col("_m2").alias("_m"), F.col("_a2").alias("_a")))
        if state.isEmpty():
            break
    return imports.join(reduce(DataFrame.union, done), ["module", "alias"], "left")


def scan_steps(files: DataFrame) -> DataFrame:
    return _per_file(files, pysource.steps, "module string, function string, body_hash string, step_id string, kind string, text string, callee string, role string, awaited boolean, line int")


def resolve_calls(steps: DataFrame, resolved: DataFrame, functions: DataFrame) -> DataFrame:
    """Call steps with target and how: a function of the module, an import's function, a class, something external, or unresolved with a reason.

    Names of the language go, as do methods of common values whose receiver nothing is known of.
    """
    calls = steps.filter(F.col("kind").isin("call", "callback")).filter(~F.col("callee").isin(*BUILTINS))
    head, rest = F.substring_index("callee", ".", 1), F.regexp_replace("callee", r"^[^.]*\.?", "")
    calls = calls.withColumns({"_head": head, "_rest": rest})
    f = functions.filter("kind <> 'error'").select("module", F.col("qualname"), F.col("kind").alias("_kind"), F.col("catalogue_id")).dropDuplicates(["module", "qualname"])
    own_class = F.when(F.col("function").contains("."), F.concat_ws(".", F.substring_index("function", ".", 1), "_rest"))
    local_name = F.when(F.col("_head").isin("self", "cls"), own_class).otherwise(F.col("callee"))
    local = f.select("module", F.col("qualname").alias("_local"), F.col("catalogue_id").alias("_t1"), F.col("_kind").alias("_k1"))
    imported = resolved.select("module", F.col("alias").alias("_head"), "target_module", "found_module", "found_name").dropDuplicates(["module", "_head"])
    far = f.select(F.col("module").alias("found_module"), F.col("qualname").alias("_far"), F.col("catalogue_id").alias("_t2"), F.col("_kind").alias("_k2"))
    j = calls.withColumn("_local", local_name).join(local, ["module", "_local"], "left").join(imported, ["module", "_head"], "left")
    # a missing part is left out of the name: module.attr, name or name.attr
    j = j.withColumn("_far", F.concat_ws(".", "found_name", F.nullif(F.col("_rest"), F.lit("")))).join(far, ["found_module", "_far"], "left")
    kind = F.coalesce("_k1", "_k2")
    how = F.when(kind == "class", "class").when(F.col("_t1").isNotNull(), "local").when(F.col("_t2").isNotNull(), "import").when(F.col("target_module").isNotNull() & F.col("found_module").isNull(), "external").otherwise("unresolved")
    target = F.coalesce("_t1", "_t2", F.when(F.col("found_module").isNull() & F.col("target_module").isNotNull(), F.concat_ws(".", "target_module", F.nullif(F.col("_rest"), F.lit("")))))
    reason = F.when(how == "unresolved", F.when(F.col("_head").isin("self", "cls"), "no such method here").when(F.col("callee").contains("."), "receiver is a value").otherwise("no such name"))
    noise = (how == "unresolved") & F.contains(F.col("callee"), F.lit(".")) & F.substring_index("callee", ".", -1).isin(*NOISE_ATTRS)
    return j.filter(~noise).select("module", "function", "step_id", "callee", "role", "awaited", "line", how.alias("how"), target.alias("target"), reason.alias("reason"))


def merge_adjacent_calls(nodes: DataFrame) -> DataFrame:
    """Runs of siblings (tree_id, parent_id, ordinal) equal in kind, name, edge and op become one node with a count; other kinds stay.

    Where nodes have `fields` (array), those of a run are united, each once, in order.
    """
    own, alike = W.partitionBy("tree_id", "parent_id").orderBy("ordinal"), W.partitionBy("tree_id", "parent_id", "kind", "name", "edge", "op").orderBy("ordinal")
    run = F.when(F.col("kind").isin("external", "class", "unresolved", "db"), F.row_number().over(own) - F.row_number().over(alike)).otherwise(-F.row_number().over(own))
    merged = [F.min("ordinal").alias("ordinal"), F.count("*").alias("count")]
    if "fields" in nodes.columns:
        inner = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fields"))), lambda x: F.coalesce(x["fields"], F.array().cast("array<string>")))
        merged.append(F.array_distinct(F.flatten(inner)).alias("fields"))
    return nodes.withColumn("_run", run).groupBy("tree_id", "parent_id", "kind", "name", "edge", "op", "_run").agg(*merged).drop("_run")


def scan_route_decls(files: DataFrame) -> DataFrame:
    return _per_file(files, pysource.route_declarations, "kind string, module string, target string, child string, method string, path string, prefix string, tags array<string>, deps array<string>, handler string, line int")


def expand_mounts(containers: DataFrame, includes: DataFrame, routes: DataFrame, max_depth: int = 50) -> DataFrame:
    """Endpoints of every app: includes are walked with prefixes joined and tags and deps gathered; a router never mounts itself.

    containers (id, kind, prefix, tags, deps), includes (parent, child, prefix, tags, deps), routes (container, method, path, tags,
    deps, handler, ord). Ids are ``METHOD path``, later ones of the same with #2, #3.
    """
    none = F.array().cast("array<string>")
    own = containers.select(F.col("id").alias("at"), F.coalesce("prefix", F.lit("")).alias("_p"), F.coalesce("tags", none).alias("_t"), F.coalesce("deps", none).alias("_d"))
    roots = containers.filter("kind = 'app'").select(F.col("id").alias("at"), F.lit("").alias("prefix"), none.alias("tags"), none.alias("deps"), F.array("id").alias("chain"))
    grow = lambda df: df.join(own, "at").select("at", F.concat("prefix", "_p").alias("prefix"), F.concat("tags", "_t").alias("tags"), F.concat("deps", "_d").alias("deps"), "chain")
    step = includes.select(F.col("parent").alias("at"), "child", F.coalesce("prefix", F.lit("")).alias("_ip"), F.coalesce("tags", none).alias("_it"), F.coalesce("deps", none).alias("_id"))
    front = durable(grow(roots))
    found = [front]
    for _ in range(max_depth):
        nxt = front.join(step, "at").filter(~F.array_contains("chain", F.col("child")))
        nxt = nxt.select(F.col("child").alias("at"), F.concat("prefix", "_ip").alias("prefix"), F.concat("tags", "_it").alias("tags"), F.concat("deps", "_id").alias("deps"), F.concat("chain", F.array("child")).alias("chain"))
        front = durable(grow(nxt))
        if front.isEmpty():
            break
        found.append(front)
    else:
        raise RuntimeError(f"routers are mounted more than {max_depth} deep")
    mounted = reduce(DataFrame.union, found)
    r = routes.select(F.col("container").alias("at"), "method", F.col("path").alias("_rp"), F.coalesce("tags", none).alias("_rt"), F.coalesce("deps", none).alias("_rd"), "handler", "ord")
    whole = F.concat("prefix", "_rp")
    ends = mounted.join(r, "at").select("method", F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole)).alias("path"), F.array_distinct(F.concat("tags", "_rt")).alias("tags"), F.array_distinct(F.concat("deps", "_rd")).alias("deps"), "handler", "chain", "ord")
    n = F.row_number().over(W.partitionBy("method", "path").orderBy("chain", "ord"))
    base = F.concat_ws(" ", "method", "path")
    return ends.withColumn("_n", n).withColumn("endpoint_id", F.when(F.col("_n") == 1, base).otherwise(F.concat(base, F.lit("#"), F.col("_n").cast("string")))).drop("_n")


def unmounted_routers(containers: DataFrame, endpoints: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, route_count) of routers with routes that no app reaches."""
    reached = endpoints.select(F.explode("chain").alias("id")).distinct()
    counts = routes.groupBy(F.col("container").alias("id")).agg(F.count("*").alias("route_count"))
    return containers.filter("kind <> 'app'").select("id").join(reached, "id", "left_anti").join(counts, "id")


def group_endpoints(endpoints: DataFrame, split: int = 20) -> DataFrame:
    """endpoints with prefix: the first literal segment, or the first two where that group has more than `split`."""
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & ~p.startswith("{"))
    key = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))
    sizes = endpoints.groupBy(key(1).alias("_k")).agg(F.count("*").alias("_n"))  # counts first: a group may hold most endpoints
    joined = endpoints.withColumns({"_k": key(1), "_k2": key(2)}).join(sizes, "_k")
    return joined.withColumn("prefix", F.when(F.col("_n") > split, F.col("_k2")).otherwise(F.col("_k"))).drop("_k", "_k2", "_n")
