import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import effect_rules, names, spans
from gleanery.functions import forms as T
from gleanery.operators import behaviors, clones, code_windows, derivation, effects, errors, file_clones, graph, macros, ownership, packs, relational, reports
from gleanery.plans import queries
from gleanery.sources import documents, pack_files, trees
from gleanery.streaming.replace import TokenTable, follow


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- names and spans


def test_paths_lose_their_arguments():
    assert names.strip_turbofish("std::vec::Vec::<u8>::with_capacity") == "std::vec::Vec::with_capacity"
    assert names.strip_turbofish("<C as Iterator>::collect::<Vec<u8>>") == "<C as Iterator>::collect"
    assert names.strip_turbofish("a::<impl Clone for T<u8>>::clone") == "a::<impl Clone for T<u8>>::clone"
    assert names.strip_turbofish("broken::<u8") == "broken::<u8"
    assert names.strip_generics("Vec::<HashMap<u8, u8>>::new") == "Vec::::new"
    assert names.self_of("<String as Clone>::clone") == "String"
    assert names.self_of("m::<impl Clone for Vec<u8>>::clone") == "Vec<u8>"
    assert names.self_of("plain::path") is None


def test_name_columns(spark):
    df = spark.createDataFrame([("a.b::Cde", "src/lib.rs"), ("9ab", "src/a/mod.rs"), ("x_1(y)", "tests/t.rs"), (None, "main.rs")], "t string, p string")
    got = [tuple(r) for r in df.select(names.trailing_identifier(F.col("t")), names.is_constructor(F.col("t")), names.module_of(F.col("p")), names.is_library_source(F.col("p"))).collect()]
    assert got == [("Cde", True, "src", True), (None, False, "src::a", True), ("y", False, "tests::t", False), (None, False, "crate", True)]
    cases = spark.createDataFrame([("DarkRed",), ("HTTPServer",), ("a",)], "n string").select(names.kebab_case(F.col("n")), names.snake_case(F.col("n")))
    assert [tuple(r) for r in cases.collect()] == [("dark-red", "dark_red"), ("http-server", "http_server"), ("a", "a")]
    long = spark.createDataFrame([("a  b\n" * 40,), ("x",)], "e string").select(names.shortened(F.col("e"))).collect()
    assert len(long[0][0]) == 80 and long[0][0].endswith("...") and long[1][0] == "x"


def test_spans_decline_without_bytes(spark):
    s = "struct<path:string,start_byte:long,end_byte:long>"
    df = spark.createDataFrame([(("a", 0, 10), ("a", 2, 5)), (("a", 0, 10), ("b", 2, 5)), (("a", None, 10), ("a", 2, 5)), (("a", 0, 10), ("a", 2, 12))], f"x {s}, y {s}")
    got = [tuple(r) for r in df.select(spans.contains(F.col("x"), F.col("y")), spans.substantially_overlaps(F.col("x"), F.col("y"))).collect()]
    assert got == [(True, True), (False, False), (False, False), (False, True)]


# --- clones


def tokens_of(spark, texts):
    files = spark.createDataFrame([(f"{i}.rs", "rust", t) for i, t in enumerate(texts)], "path string, domain string, text string")
    return trees.tokenize(files)


CODE = """fn total(prices: Vec<u32>) -> u32 {
    let mut sum = 0;
    for price in prices {
        if price > 10 {
            sum += price;
        }
    }
    return sum;
}
"""


def test_layout_and_comments_do_not_hide_a_clone(spark):
    other = "// about\n" + CODE.replace("    ", "\t").replace("{\n", "{ // here\n")
    got = clones.clones(tokens_of(spark, [CODE, other]), k=12, min_lines=4).collect()
    assert len(got) == 1 and got[0]["tokens"] >= 12 and got[0]["changed"] == 0


def test_renamed_clones_are_near_and_equal_ones_are_not(spark):
    renamed = CODE.replace("prices", "scores").replace("price", "score").replace("total", "points").replace("sum", "count")
    got = clones.clones(tokens_of(spark, [CODE, CODE, renamed]), k=20, min_lines=5, rename=("identifier", "literal"), max_changed_percent=50).collect()
    assert {frozenset((r["left_path"], r["right_path"])) for r in got} == {frozenset(("0.rs", "2.rs")), frozenset(("1.rs", "2.rs"))} and all(r["changed"] > 0 for r in got)


def test_renaming_must_be_consistent(spark):
    t = clones.encoded(tokens_of(spark, ["x + x + 1", "a + b + 1"]), ("identifier",))
    assert clones.windows(t, 5).select("digest").distinct().count() == 2


def test_runs_of_edges_are_runs_of_all_seeds(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(5, 30))) for _ in range(8)]
    w = clones.windows(clones.encoded(tokens_of(spark, texts)), 4).cache()
    assert rows(clones.runs(w, 4).select(clones._MATCH)) == rows(clones.merge_runs(clones.seeds(w, 4), 4))


def test_maximal_runs_without_shuffled_pairs(spark, tmp_path, monkeypatch):
    docs = word_docs(spark)
    for k, small in ((4, 64), (6, 3), (16, 3)):
        monkeypatch.setattr(code_windows, "_SMALL", small)
        monkeypatch.setattr(code_windows, "_PAIRS", 200)
        w = clones.windows(clones.encoded(queries.word_tokens(docs)), k, renamed=False).cache()
        got = code_windows.maximal_runs(queries.word_files(docs), k)
        assert rows(got.select(clones._MATCH)) == rows(clones.merge_runs(clones.seeds(w, k), k))
    assert code_windows.maximal_runs(queries.word_files(docs.where("false")), 4).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.w2_maximal_runs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def word_docs(spark):
    """Documents with common passages, null and short texts, a null language, and words that repeat throughout."""
    rng = random.Random(21)
    line, other = (" ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(2))
    texts = [" ".join([*(rng.choice("ab") for _ in range(rng.randrange(30))), rng.choice([line, other, line[: rng.randrange(60)]]), *(rng.choice("xyz") for _ in range(rng.randrange(9)))]) for _ in range(80)]
    texts += [None, "", "one two", "a " * 60, "a " * 40, line, line]
    return spark.createDataFrame([(i, t, None if i % 11 == 0 else rng.choice(["en", "de"])) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def named_docs(spark):
    """Passages whose long words are changed throughout, in one place, or not, with null and short texts and repeats."""
    rng = random.Random(5)
    passages = [[rng.choice(["a", "b", "of", "to", "first", "second", "third", "123456"]) for _ in range(30)] for _ in range(4)]
    texts = []
    for i in range(70):
        words = list(rng.choice(passages))
        if i % 3:
            names = {"first": rng.choice(["first", "other"]), "second": rng.choice(["second", "fifth"])}
            words = [names.get(w, w) for w in words]
        if i % 5 == 0:
            words[rng.randrange(30)] = "inplace"
        texts.append(" ".join([*(rng.choice("abcd") for _ in range(rng.randrange(9))), *words[rng.randrange(5) :], *(rng.choice(["first", "other", "x"]) for _ in range(rng.randrange(9)))]))
    texts += [None, "", "one", "first " * 50, "other " * 30, "first other " * 20, "other first " * 25]
    return spark.createDataFrame([(i if i != 9 else None, t, None if i % 13 == 0 else rng.choice(["en", "de"])) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def test_renamed_clones_without_shuffled_runs(spark, tmp_path):
    docs = named_docs(spark)
    for k, percent in ((9, 50), (12, 20)):
        tokens = queries.word_tokens(docs).withColumn("class", F.when(F.length("lexeme") >= 5, "name").otherwise("other"))
        want = clones.clones(tokens, k=k, min_lines=2, rename=("name",), max_changed_percent=percent)
        got = queries.clones_of_words(docs, k, min_letters=5, max_changed_percent=percent)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert rows(got) == rows(want) and got.count() > 50
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.near_clones(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_exact_clones_without_shuffled_runs(spark, tmp_path):
    docs = word_docs(spark)
    for k in (9, 16):
        want = clones.clones(queries.word_tokens(docs), k=k, min_lines=2)
        got = queries.clones_of_words(docs, k)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert rows(got) == rows(want) and got.count() > 50
    assert queries.clones_of_words(docs.where("false"), 16).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.exact_clones(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_chosen_runs_are_those_of_a_plain_search():
    rng = np.random.default_rng(3)
    own, n = np.sort(rng.integers(0, 6, 600)), rng.integers(4, 30, 600)
    ls, rs, changed = rng.integers(0, 60, 600), rng.integers(0, 60, 600), rng.integers(0, 3, 600)
    # on one diagonal no run holds another
    one = np.unique(np.stack([own, rs - ls]), axis=1, return_index=True)[1]
    own, ls, rs, n, changed = (v[one] for v in (own, ls, rs, n, changed))
    held = lambda i, j: own[i] == own[j] and i != j and ls[j] <= ls[i] and rs[j] <= rs[i] and ls[j] + n[j] >= ls[i] + n[i] and rs[j] + n[j] >= rs[i] + n[i]
    left = [i for i in range(len(own)) if not any(held(i, j) for j in range(len(own)))]
    kept = []
    for i in sorted(left, key=lambda i: (own[i], -n[i], changed[i], ls[i], rs[i])):
        both = lambda s, j: min(s[i] + n[i], s[j] + n[j]) - max(s[i], s[j])
        if not any(own[i] == own[j] and 5 * both(ls, j) >= 4 * n[i] and 5 * both(rs, j) >= 4 * n[i] for j in kept):
            kept.append(i)
    assert len(left) < len(own) and sorted(file_clones._chosen(own, ls, rs, n, changed).tolist()) == sorted(kept)


def test_groups_of_windows_are_counted_without_a_row_for_each(spark, tmp_path):
    docs = word_docs(spark)
    got = code_windows.window_groups(queries.word_files(docs), 8)
    w = clones.windows(clones.encoded(queries.word_tokens(docs)), 8, renamed=False)
    assert rows(got) == rows(w.groupBy("domain").agg(F.count("*"), F.countDistinct("digest")))
    assert got.count() == 3
    assert code_windows.window_groups(queries.word_files(docs.where("false")), 8).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.w1_a1_windows(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_starts_of_runs_are_counted_without_pairs(spark, tmp_path):
    docs = word_docs(spark)
    for k in (4, 6, 16):
        w = clones.windows(clones.encoded(queries.word_tokens(docs)), k, renamed=False).cache()
        want = clones.seeds(w, k, "before").groupBy("left_file").agg(F.count("*"), F.sum("left_start"), F.sum("right_start"))
        assert rows(code_windows.run_starts(queries.word_files(docs), k)) == rows(want)
    assert code_windows.run_starts(queries.word_files(docs.where("false")), 4).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.j1_run_starts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_configuration_is_checked(spark):
    with pytest.raises(ValueError):
        clones.clones(None, k=0)


def test_a_stream_of_files_gives_what_a_fresh_run_gives(spark, tmp_path):
    schema = "path string, domain string, text string, version long"
    src = tmp_path / "in"
    spark.createDataFrame([("a.rs", "rust", CODE, 1), ("b.rs", "rust", CODE, 1), ("c.rs", "rust", "fn c() {}", 1)], schema).coalesce(1).write.json(str(src))
    table = TokenTable(spark, str(tmp_path / "table"), trees.tokenize)

    def run():
        follow(spark.readStream.schema(schema).json(str(src)), table, str(tmp_path / "cp")).awaitTermination()

    run()
    assert clones.clones(table.read(), 12, 4).count() == 1
    spark.createDataFrame([("b.rs", "rust", "fn other() { x(); }", 2), ("b.rs", "rust", "stale", 1), ("c.rs", "rust", None, 2)], schema).coalesce(1).write.mode("append").json(str(src))
    run()
    fresh = trees.tokenize(spark.createDataFrame([("a.rs", "rust", CODE), ("b.rs", "rust", "fn other() { x(); }")], "path string, domain string, text string"))
    assert rows(table.read().select(fresh.columns)) == rows(fresh)
    assert clones.clones(table.read(), 12, 4).count() == 0


# --- graphs


def test_labels_flow_around_cycles(spark):
    flows = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (5, 6, "c"), (6, 5, "d"), (1, 0, "e")], "into long, from long, span string")
    seeds = spark.createDataFrame([(2, 7, "o", "s"), (2, 7, "p", "t")], "node long, label long, origin string, span string")
    assert rows(graph.closure(flows, seeds)) == [(0, 7), (1, 7), (2, 7)]
    named = spark.createDataFrame([(i,) for i in range(7)], "node long")
    got = graph.witnesses(flows, seeds, named).collect()
    assert sorted((r["start"], len(r["path"]), r["origin"]) for r in got) == [(0, 2, "o"), (0, 2, "p"), (1, 1, "o"), (1, 1, "p"), (2, 0, "o"), (2, 0, "p")]
    assert [tuple(x) for r in got if r["start"] == 0 and r["origin"] == "o" for x in r["path"]] == [(0, 1, "a"), (1, 2, "b")]
    assert graph.first_witness(graph.witnesses(flows, seeds, named)).count() == 3
    unnamed = graph.witnesses(flows, seeds, named.where("node <> 1"))
    assert {r["start"] for r in unnamed.collect()} == {2}


def brute_witness(flows, seeds, start):
    """First-in first-out over sorted flows, marked when taken up."""
    seen, queue = {start}, [(start, [])]
    while queue:
        at, path = queue.pop(0)
        if at in seeds:
            return path
        for i, f, s in sorted(flows):
            if i == at and f not in seen:
                seen.add(f)
                queue.append((f, [*path, (i, f, s)]))
    return None


def test_witnesses_are_those_of_breadth_first_search(spark):
    rng = random.Random(3)
    flows = list({(rng.randrange(12), rng.randrange(12), str(rng.randrange(3))) for _ in range(30)})
    seeds = {3, 8}
    got = graph.witnesses(spark.createDataFrame(flows, "into long, from long, span string"), spark.createDataFrame([(s, 1, "o", "x") for s in seeds], "node long, label long, origin string, span string"), spark.range(12).withColumnRenamed("id", "node"))
    want = {s: p for s in range(12) if (p := brute_witness(flows, seeds, s)) is not None}
    assert {r["start"]: [tuple(x) for x in r["path"]] for r in got.collect()} == want


def test_witnesses_of_the_query_cover_the_whole_graph(spark, tmp_path):
    from gleanery.plans.queries import r3_witnesses

    for name, rows, schema in (
        ("nation", [(0, 0), (1, 0), (2, 1)], "n_nationkey int, n_regionkey int"),
        ("supplier", [(1, 0, -5.0), (2, 1, 3.0), (3, 2, 9.0)], "s_suppkey int, s_nationkey int, s_acctbal double"),
        ("customer", [(1, 0), (2, 1), (3, 2)], "c_custkey int, c_nationkey int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    flows = [(0, 100), (0, 101), (1, 102), (100, 1001), (101, 1002), (102, 1003), (1000001, 100), (1000002, 101), (1000003, 102), (100, 0), (101, 0), (102, 1)]
    flows = [(a, b, "s") for a, b in flows]
    nodes = {x for f in flows for x in f[:2]}
    want = {n: p for n in nodes if (p := brute_witness(flows, {1001}, n)) is not None}
    got = {r["start"]: [tuple(x) for x in r["path"]] for r in r3_witnesses(spark, str(tmp_path)).collect()}
    assert got == want and {1000001, 1000002} <= set(got)


def test_reach_classes(spark):
    # 0 <- 1 <- 2 (fallible) ; 3 <- 4 <- 5 ; 6 alone ; 7 <-> 8
    kinds = {0: "infallible", 1: "infallible", 2: "fallible", 3: "optional", 4: "infallible", 5: "infallible", 6: "infallible", 7: "infallible", 8: "infallible", 9: "fallible"}
    callables = spark.createDataFrame([(i, k) for i, k in kinds.items()], "callable_id long, containment string")
    callers = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5), (7, 8), (8, 7)], "callee long, caller long")
    got = {r["start"]: (r["reach"], r["path"]) for r in errors.reach(callables, callers, callables).collect()}
    assert got[0] == ("ancestor", [2, 1, 0]) and got[3] == ("sealed", [5, 4, 3]) and got[6] == ("unknown", None) and got[9] == ("local", None) and got[7] == ("sealed", [8, 7])


def test_shortest_route_wins(spark):
    callables = spark.createDataFrame([(i, "infallible") for i in range(4)], "callable_id long, containment string")
    callers = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3)], "callee long, caller long")
    got = {r["start"]: r["path"] for r in errors.reach(callables.where("callable_id = 0"), callers, callables).collect()}
    assert got[0] == [2, 1, 0]


# --- errors


def test_discards_have_their_callable_and_certainty(spark):
    sites = spark.createDataFrame([(1, "src/a.rs", "ok-discard", "x.read()  \n .ok()", "read", False, 15), (1, "src/a.rs", "unwrap-or", "y", None, True, 16), (1, "src/a.rs", "ok-discard", "z.get()", "get", False, 18), (1, "src/a.rs", "panic", "w", None, False, 95), (1, "src/a.rs", "err-arm", "v", None, False, 40)], "file_id long, path string, form string, expression string, receiver_method string, binds_cause boolean, at long")
    queries = spark.createDataFrame([("ok-discard", "get")], "form string, receiver_method string")
    regions = spark.createDataFrame([(1, "callable", "10", 10, 50), (1, "callable", "11", 14, 20), (1, "test", "t", 35, 60)], "file_id long, kind string, name string, start long, end long")
    callables = spark.createDataFrame([(10, "a::outer", "fallible"), (11, "a::outer::inner", "infallible")], "callable_id long, path string, containment string")
    got = {r["form"]: r for r in errors.discards(sites, queries, regions, callables, ["err-arm"]).collect()}
    assert set(got) == {"ok-discard", "panic", "err-arm"}
    assert (got["ok-discard"]["callable"], got["ok-discard"]["expression"], got["ok-discard"]["certainty"]) == ("a::outer::inner", "x.read() .ok()", "certain")
    assert (got["panic"]["callable"], got["panic"]["containment"]) == ("src::a", "infallible")
    assert (got["err-arm"]["certainty"], got["err-arm"]["in_test"], got["err-arm"]["containment"]) == ("possible", True, "fallible")


def test_containment_of_return_types(spark):
    df = spark.createDataFrame([("Result<Option<u8>, E>",), ("Option<Result<u8, E>>",), ("u8",), (None,)], "r string")
    f = lambda unchecked: [r[0] for r in df.select(errors.containment(F.col("r"), ["Result"], ["Option"], unchecked)).collect()]
    assert f(False) == ["fallible", "optional", "infallible", "infallible"] and f(True) == ["fallible", "optional", "fallible", "fallible"]


# --- effects


def test_allocation_rules(spark):
    plain = spark.createDataFrame([(x,) for x in ["alloc::vec::Vec::with_capacity", "Box::new", "values.collect", "Vec::new", "new", "self.name.to_string"]], "c string")
    assert [r[0] for r in plain.select(effect_rules.allocating_call(F.col("c"))).collect()] == ["Vec::with_capacity", "Box::new", "collect", None, None, "to_string"]
    dest = spark.createDataFrame([(x,) for x in ["<std::string::String as Clone>::clone", "<u32 as Clone>::clone", "<str as ToOwned>::to_owned", "<I as Iterator>::collect::<std::vec::Vec<u8>>", "<I as Iterator>::collect::<Summary>", "std::fmt::format", "std::boxed::Box::<u8>::new"]], "d string")
    d = dest.withColumn("p", names.without_turbofish("d")).withColumn("g", names.without_generics("d")).withColumn("s", names.qualified_self("p"))
    assert [r[0] for r in d.select(effect_rules.allocating_destination(F.col("d"), F.col("p"), F.col("g"), F.col("s"))).collect()] == ["String::clone", None, "str::to_owned", "collect::<Vec>", None, "std::fmt::format", "Box::new"]
    macros_ = spark.createDataFrame([("format", False), ("vec", True), ("vec", False), ("println", True)], "n string, a boolean")
    assert [r[0] for r in macros_.select(effect_rules.allocating_macro(F.col("n"), F.col("a"))).collect()] == ["format!", "vec!", None, None]
    assert effect_rules.effect_codes(spark).count() == 11


def test_calls_balance_and_unresolved_ones_are_told(spark):
    from gleanery.plans import inline

    callables = spark.sql(inline.CALLABLES)
    calls = effects.classify_calls(spark.sql(inline.CALLS), callables, effects.merged_catalog(spark.sql(inline.CATALOG)))
    a = effects.call_accounting(calls).first().asDict()
    assert a.pop("total") == sum(a.values()) == 12
    seeds, flows = effects.seeds_and_flows(calls, spark.createDataFrame([(5, "format", True, "m")], "caller_id long, name string, has_arguments boolean, span string"))
    traced = effects.traces(seeds, flows, callables)
    assert {r["effect"] for r in traced.collect() if r["callable"] == "util::Graph::walk"} == {"allocate"}
    told = effects.unresolved_diagnostics(calls, callables, traced).collect()
    assert [r["caller"] for r in told] == ["util::Tree::walk"]
    public = callables.where("name = 'service'")
    assert rows(effects.effects_by_path(traced, public)) == [("app::service", ["block", "file-read"])]


def test_observed_edges(spark):
    edges = spark.createDataFrame([(0, "a", ["std::fs::read::<&str>"], "s"), (1, "a", ["b", "c"], "t"), (2, "x", ["a"], "u")], "edge_id long, from string, to array<string>, span string")
    defs = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    catalog = spark.createDataFrame([("std::fs::read", ["file-read"])], "path string, effects array<string>")
    got = effects.classify_edges(edges, defs, catalog).where("counted").collect()
    assert sorted((r["edge_id"], r["bucket"]) for r in got) == [(0, "known_effect_origins"), (1, "linked_internal"), (2, "linked_internal")]
    assert rows(effects.missing_ends(edges, defs)) == [("x", "u")]


# --- relational


def test_wrappers_and_outermost(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 5), ("a", 6, 9), ("a", 20, 30), ("b", 0, 3)], "k string, start long, end long")
    assert rows(relational.drop_wrappers(df, "k")) == [("a", 2, 5), ("a", 20, 30), ("a", 6, 9), ("b", 0, 3)]
    assert rows(relational.keep_outermost(df, "k")) == [("a", 0, 10), ("a", 20, 30), ("b", 0, 3)]


# --- macros, ownership, packs


def test_ownership_cannot_own_by_declaration():
    assert not {c for _, c, *_ in ownership.DECLARATION_RULES} & set(ownership.OWNING)


def test_fnv_of_texts(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h >> 1

    texts = ["", "a", "foobar", "é" * 20]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ownership.fnv1a(F.col("t"))).collect()]
    assert got == [fnv(t.encode()) for t in texts]


def test_scores_by_fold(spark):
    c = spark.createDataFrame([(1, "FFI", "a"), (2, "FFI", "b"), (3, "STATIC", "a")], "field_id long, class string, file string")
    t = spark.createDataFrame([(1, "FFI"), (2, "OWNED"), (3, "STATIC")], "field_id long, class string")
    got = ownership.scored(c, t).groupBy("class").agg(F.sum("answers"), F.sum("right_answers"))
    assert rows(got) == [("FFI", 2, 1), ("STATIC", 1, 1)]


def test_runtime_capabilities(spark):
    m = spark.createDataFrame([("p", ["rust.syntax-tree", "x", "y"])], "name string, requires array<string>")
    p = spark.createDataFrame([("x",)], "capability string")
    lang = spark.createDataFrame([("rust",)], "language string")
    assert rows(packs.missing_capabilities(m, p, lang)) == [("p", "y")]


def test_packs_round_trip_and_tampering_is_seen(tmp_path):
    root = tmp_path / "pack"
    (root / "b").mkdir(parents=True)
    (root / "b/x.json").write_text("{}")
    m = {"schema": 1, "name": "rust-std", "version": "1.0", "language": "rust", "provides": ["effects"], "contents": [{"path": "b/x.json", "kind": "behaviors", "sha256": pack_files.sha256(b"{}")}]}
    assert pack_files.parse(pack_files.to_toml(m)) == m and pack_files.to_toml(pack_files.parse(pack_files.to_toml(m))) == pack_files.to_toml(m)
    one, two = (pack_files.write_oci(m, root, tmp_path / n) for n in ("one", "two"))
    assert one == two and (tmp_path / "one/index.json").read_bytes() == (tmp_path / "two/index.json").read_bytes()
    cache = pack_files.Cache(tmp_path / "cache")
    d = cache.add(tmp_path / "one")
    assert cache.list() == [(d, m)] and cache.load(d, "behaviors") == [("b/x.json", b"{}")] and cache.load(d, "effects") == []
    (root / "b/x.json").write_text("{ }")
    with pytest.raises(ValueError):
        pack_files.verify(m, root)
    for wrong in ({"path": "../x"}, {"sha256": "no"}):
        assert pack_files.validate(m | {"contents": [m["contents"][0] | wrong]})
    (blob,) = [p for p in (tmp_path / "two/blobs/sha256").iterdir() if p.read_bytes() == b"{}"]
    blob.write_text("[]")
    with pytest.raises(ValueError):
        pack_files.read_oci(tmp_path / "two")


def test_builders_answer_in_json():
    import sys

    code = "import json, sys; print(json.dumps({'got': json.load(sys.stdin)}))"
    assert pack_files.run_builder([sys.executable, "-c", code], {"a": 1}) == {"got": {"a": 1}}
    with pytest.raises(RuntimeError):
        pack_files.run_builder([sys.executable, "-c", "raise SystemExit(3)"], {})


# --- sources


def test_trees_are_scanned_with_diagnostics(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/lib.rs").write_text(CODE)
    (tmp_path / "src/bad.rs").write_bytes(b"fn \xff")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests/t.rs").write_text("fn t() {}")
    (tmp_path / "notes.txt").write_text("x")
    files, bad = trees.scan(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["src/lib.rs", "tests/t.rs"] and [r["path"] for r in bad.collect()] == ["src/bad.rs"]
    assert [r["path"] for r in trees.library(files).collect()] == ["src/lib.rs"]


def test_digests_and_patches(tmp_path):
    assert trees.identity_digest([("i", "x", "identifier"), ("i", "x", "identifier")], ("identifier",)) == trees.identity_digest([("i", "y", "identifier"), ("i", "y", "identifier")], ("identifier",)) != trees.identity_digest([("i", "y", "identifier"), ("i", "z", "identifier")], ("identifier",))
    assert trees.identity_digest([("a", "bc", "o")]) != trees.identity_digest([("ab", "c", "o")])
    src = b'const a = self.#x; // #no\nconst s = "#no"; #y: u8'
    assert trees.patch_private_fields(src) == b'const a = self._x; // #no\nconst s = "#no"; _y: u8'
    (tmp_path / "a").write_text("1")
    before = trees.tree_digest(tmp_path)
    (tmp_path / "a").write_text("2")
    assert trees.tree_digest(tmp_path) != before
    (tmp_path / "l").symlink_to(tmp_path / "a")
    with pytest.raises(ValueError):
        trees.tree_digest(tmp_path)
    assert trees.package_sources([str(tmp_path), str(tmp_path / "none")], "p", "1") == ([], [str(tmp_path / "none")])


def test_documents_catalogs_and_sinks(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/b.json").write_text('{"a": 1}')
    (tmp_path / "j/a.json").write_text('{"a": 2}')
    assert sorted(r["a"] for r in documents.load_json(spark, [str(tmp_path / "j")], "a long").collect()) == [1, 2]
    (tmp_path / "j/c.json").write_text("{")
    with pytest.raises(Exception):
        documents.load_json(spark, [str(tmp_path / "j")], "a long").collect()
    with pytest.raises(FileNotFoundError):
        documents.load_json(spark, [], "a long")
    assert documents.load_json(spark, [], "a long", required=False).count() == 0
    u8 = {"primitive": "u8"}
    fn = lambda ins, out: {"function": {"sig": {"inputs": ins, "output": out}}}
    doc = {
        "index": {
            "1": {"name": "free", "crate_id": 0, "inner": fn([["x", {"borrowed_ref": {"is_mutable": False, "type": u8}}]], {"resolved_path": {"name": "Vec", "args": {"angle_bracketed": {"args": [{"type": u8}]}}}})},
            "2": {"name": "Tr", "crate_id": 0, "inner": {"trait": {"items": [3]}}},
            "3": {"name": "go", "crate_id": 0, "inner": fn([["self", {"generic": "Self"}]], None)},
            "4": {"name": "T", "crate_id": 0, "inner": {"impl": {"items": [5]}}},
            "5": {"name": "hidden", "crate_id": 0, "inner": fn([], None)},
        },
        "paths": {"1": {"path": ["k", "free"]}, "2": {"path": ["k", "Tr"]}},
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    cat = documents.catalog(spark, str(tmp_path / "doc.json"), "k", "1")
    assert rows(cat.select("path", "kind", "signature")) == [("k::Tr::go", "method", "(Self) -> ()"), ("k::free", "function", "(&u8) -> Vec<u8>")]
    assert rows(documents.reachable(cat, spark.createDataFrame([("k::Tr",)], "module string")).select("path")) == [("k::free",)]
    documents.write_jsonl(cat, str(tmp_path / "out"))
    documents.write_tsv(cat, str(tmp_path / "tsv"))
    documents.parquet(cat, str(tmp_path / "pq"))
    assert spark.read.json(str(tmp_path / "out")).count() == spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "tsv")).count() == spark.read.parquet(str(tmp_path / "pq")).count() == 2


# --- behaviours


def test_metrics_of_nodes_are_those_of_terms(spark):
    rng = random.Random(5)
    from tests.test_terms import random_form

    fs = [random_form(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, T.dumps(f)) for i, f in enumerate(fs)], "form_id long, form string")
    nodes = behaviors.node_table(df)
    got = {r["form_id"]: r for r in behaviors.metrics(nodes).collect()}
    for i, f in enumerate(fs):
        assert {k: got[i][k] for k in ("size", "depth", "anchors", "holes")} == T.metrics(f)
    anchors = {}
    for r in behaviors.anchor_rows(nodes).collect():
        anchors.setdefault(r["form_id"], set()).add(r["anchor"])
    assert all(anchors.get(i, set()) == T.anchor_names(f) for i, f in enumerate(fs))


def test_library_behaviours_are_found_in_functions(spark):
    lib = 'def keep(xs, f):\n    return [x.value for x in xs if x.ok]\n'
    repo = "def mine(items):\n    log(items)\n    out = []\n    for i in items:\n        if i.ok:\n            out.append(i.value)\n    return out\ndef other(a):\n    return [b.name for b in a]\n"
    files = spark.createDataFrame([("lib.py", lib), ("repo.py", repo), ("bad.py", "def (")], "path string, text string")
    forms = behaviors.python_forms(files)
    assert forms.where("name is null").count() == 1
    forms = forms.where("name is not null").withColumn("form", behaviors.simplified("form")).withColumn("id", F.xxhash64("path", "name"))
    side = lambda p, c: forms.where(f"path = '{p}'").select(F.col("id").alias(c), F.lit("python").alias("language"), F.col("path").alias("source_sha256"), "form", "name")
    library, functions_ = side("lib.py", "library_id"), side("repo.py", "function_id")
    got = behaviors.match(library, functions_).join(functions_.select("function_id", "name"), "function_id").collect()
    assert [(r["name"], r["mode"]) for r in got] == [("mine", "exact")]
    assert behaviors.match(library, functions_.withColumn("language", F.lit("rust"))).count() == 0
    assert behaviors.match(library, functions_.withColumn("source_sha256", F.lit("sha256:lib.py"))).count() == 0
    keys = forms.select(behaviors.canonical_text("form").alias("form"), F.col("path").alias("container"), "name")
    assert reports.collisions(keys).count() == 0


def test_delegation_ends_where_work_is_done(spark):
    c = spark.createDataFrame([(1, "a", "fa", "b"), (2, "b", "fb", "c"), (3, "c", "fc", None), (4, "d", "fd", "twin"), (5, "twin", "f", None), (6, "twin", "f", None)], "callable_id long, name string, form string, delegates_to string")
    got = {r["start"]: (r["callable_id"], r["hops"]) for r in behaviors.delegations(c).collect()}
    assert got[1] == (3, 2) and got[2] == (3, 1) and got[3] == (3, 0) and got[4] == (4, 0)


def test_coverage_and_macros(spark):
    assert rows(reports.coverage(spark.createDataFrame([("a", 1, 4), ("a", 2, 4)], "k string, d long, t long"), "k", "d", "t")) == [("a", 37.5)]
    v = spark.createDataFrame([("E", 0, "A"), ("E", 1, "B")], "type string, pos int, variant string")
    e = spark.createDataFrame([("E", 1, "B"), ("E", 0, "A")], "type string, pos int, element string")
    assert rows(macros.variant_arrays(v, e)) == [("E",)]


def test_command_line(tmp_path, capsys):
    from gleanery.__main__ import main

    (tmp_path / "a").write_text("1")
    assert main(["digest", str(tmp_path)]) == 0 and len(capsys.readouterr().out.strip()) == 64
    assert main(["pack", "validate", str(tmp_path)]) == 2


def test_derivations_say_why_not(spark):
    good = T.dumps(T.Form("traverse", None, (T.Form("free", 0), T.Form("method", "push", (T.Form("path", "out"), T.Form("method", "get", (T.Form("local", 0),))))), (T.Pattern("bind", 0),)))
    deep = T.Form("lit")
    for _ in range(40):
        deep = T.Form("return", None, (deep,))
    c = spark.createDataFrame([(1, "a", None, "b"), (2, "b", good, None), (3, "c", None, "gone"), (4, "d", None, None), (5, "e", T.dumps(deep), None), (6, "f", T.dumps(T.Form("lit")), None)], "callable_id long, name string, form string, delegates_to string")
    got = {r["start"]: r["refusal"] or r["form"] for r in behaviors.derive(c).collect()}
    assert got == {1: good, 2: good, 3: "no-implementation", 4: "no-body", 5: "too-deep", 6: "not-comparable"}


def test_following_and_apart(spark):
    items = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "z")], "parent string, at long, v string")
    assert rows(relational.following(items, "parent", "at", "v").select("v", "following")) == [("x", "y"), ("y", "p"), ("z", "q")]
    r = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 5, 6), ("b", 1, 2)], "k string, start long, end long")
    assert rows(relational.apart(r, "k")) == [("a", 0, 5), ("a", 5, 6), ("b", 1, 2)]


def test_reports_in_words(spark):
    sub = spark.createDataFrame([("(do x)", 7, "a.py", 1, "f"), ("(do x)", 7, "b.py", 1, "g")], "form string, size int, file string, line int, name string")
    dup = reports.duplication(sub, F.col("file"))
    text = reports.markdown(reports.shapes(sub, 6, 400), dup)
    assert "| 2 | 2 | 7 | `(do x)` |" in text and "| 2 | 2 | `(do x)` |" in text
    nodes = behaviors.node_table(spark.createDataFrame([(1, T.dumps(T.Form("opaque", "goto", (T.Form("lit"),))))], "form_id long, form string"))
    assert rows(behaviors.opacity(nodes)) == [("goto", 1, 50.0)]


def test_macros_name_a_case_only_where_it_is_decided(spark):
    v = spark.createDataFrame([("One", 0, "A"), ("One", 1, "B"), ("Two", 0, "DarkRed"), ("Gap", 0, "A"), ("Gap", 1, "B")], "type string, pos int, variant string")
    arms = spark.createDataFrame([("One", "A", "a"), ("One", "B", "b"), ("Two", "DarkRed", "dark_red"), ("Gap", "A", "a")], "type string, variant string, value string")
    none = spark.createDataFrame([], "type string, pos int, element string")
    shown = spark.createDataFrame([("One",), ("Gap",)], "type string")
    wants = lambda x: spark.createDataFrame(x, "type string, case string")
    got = lambda w: rows(macros.matches(v, arms, shown, none, wants(w)))
    display = [("One", "Display", "kebab-case"), ("One", "Display", "snake_case")]
    assert got([]) == sorted([*display, ("Two", "AsRefStr", "snake_case")])
    assert got([("One", "snake_case"), ("Two", "kebab-case")]) == sorted([*display, ("One", "AsRefStr", "snake_case")])


def test_best_clone_of_each_pair_of_units(spark):
    text = [f"w{i}" for i in range(40)]
    token = lambda f, i, w: (f, f"p{f}", "d", i, "word", w, "other", i * 10, i * 10 + 9, i, i)
    left = text[:12] + ["x"] + text[12:30]
    tokens = spark.createDataFrame([token(1, i, w) for i, w in enumerate(text)] + [token(2, i, w) for i, w in enumerate(left)], "file_id long, path string, domain string, ordinal int, kind string, lexeme string, class string, start_byte long, end_byte long, start_line int, end_line int")
    every = clones.clones(tokens, k=6, min_lines=2)
    assert sorted(r["tokens"] for r in every.collect()) == [12, 18]
    units = spark.createDataFrame([(1, 0, 1000), (2, 0, 1000)], "file_id long, start_byte long, end_byte long")
    assert [r["tokens"] for r in clones.clones(tokens, k=6, min_lines=2, units=units).collect()] == [18]


# --- behaviours of libraries


def _methods(*names):
    """A chain of calls on a local: plumbing, no work."""
    form = T.Form("local", 0)
    for n in names:
        form = T.Form("method", n, (form,))
    return form


def _walk(name):
    return T.Form("traverse", None, (T.Form("free", 0), T.Form("method", name, (T.Form("local", 1),))), (T.Pattern("bind", 1),))


def _found(name):
    """The body of one step of a lazy type that yields the items `name` accepts."""
    some = T.Form("return", None, (T.Form("variant", "Some", (T.Form("local", 1),)),))
    loop = T.Form("traverse", None, (T.Form("free", 0), T.Form("branch", None, (T.Form("method", name, (T.Form("local", 1),)), some))), (T.Pattern("bind", 1),))
    return T.Form("do", None, (loop, T.Form("variant", "None")))


def _call(name):
    return T.Form("call", None, (T.Form("path", f"lib::{name}"), T.Form("local", 0)))


CALLABLES = "library string, callable_id long, name string, container string, source string, form string"


def _derived(spark, rows_, declared=()):
    data = [(lib, i, n, c, s, None if f is None else T.dumps(f)) for lib, i, n, c, s, f in rows_]
    callables = spark.createDataFrame(data, CALLABLES)
    declarations = spark.createDataFrame(list(declared), "library string, type string, source string")
    out = derivation.derive_library(callables, declarations)
    return callables, out, {r["start"]: (list(r["chain"]), r["refusal"] or str(T.loads(r["form"]))) for r in out.collect()}


def test_what_a_term_only_calls_or_builds():
    assert T.delegation_target(T.Form("return", None, (_call("a::go"),))) == "go"
    assert T.delegation_target(T.Form("do", None, (_methods("m"), _methods("n")))) is None
    assert T.delegation_target(T.Form("call", None, (T.Form("local", 0),))) is None and T.delegation_target(T.Form("lit")) is None
    built = T.Form("construct", "Own")
    assert T.constructed_type(T.Form("opaque", "x", (T.Form("local", 0), T.Form("return", None, (built,))))) == "Own"
    assert T.constructed_type(T.Form("do", None, (built, built))) is None and T.constructed_type(T.Form("local", 0)) is None


def test_behaviours_follow_helpers_and_constructed_types(spark):
    build = lambda t: T.Form("construct", t)
    table = [
        ("l", 0, "counts", None, "a", _call("helper")),
        ("l", 1, "helper", None, "a", _walk("go")),
        ("l", 2, "filtered", "Iterator", "a", build("Filtered")),
        ("l", 3, "next", "Filtered", "a", _call("search")),
        ("l", 4, "search", None, "b", _found("ok")),
        ("l", 5, "next_back", "Filtered", "a", _walk("back")),
        ("l", 6, "round", None, "a", _call("trip")),
        ("l", 7, "trip", None, "a", _call("round")),
        ("l", 8, "to_none", None, "a", _call("bare")),
        ("l", 9, "bare", None, "a", None),
        ("l", 10, "twice", None, "a", build("Two")),
        ("l", 11, "next", "Two", "x", _walk("one")),
        ("l", 12, "next", "Two", "y", _walk("two")),
        ("l", 13, "far", None, "a", build("Far")),
        ("l", 14, "next", "Far", "z", _walk("far")),
        ("l", 15, "new", "Far", "z", build("Self")),
        ("k", 16, "helper", None, "a", _walk("another library")),
        ("l", 17, "same", "Trait", "a", _call("same")),
        ("l", 18, "same", None, "b", _walk("work")),
    ]
    callables, out, got = _derived(spark, table, [("l", "Two", "x"), ("l", "Two", "y"), ("l", "Far", "z"), ("l", "Far", "z")])
    assert got[0] == ([0, 1], str(_walk("go")))
    assert got[2] == ([2, 3, 4], "(retain f0 v1 (method ok v1))"), "a search found inside a step is the whole operation"
    assert got[4] == ([4], str(_found("ok"))), "a search that is not inside a step stays"
    assert got[6] == ([6, 7], "not-comparable") and got[8] == ([8, 9], "no-body") and got[9] == ([9], "no-body")
    assert got[10] == ([10], "not-comparable"), "a type declared twice is not followed elsewhere"
    assert got[13] == ([13, 14], str(_walk("far"))) and got[15] == ([15, 14], str(_walk("far")))
    assert got[17] == ([17, 18], str(_walk("work"))), "a wrapper is not its own implementation"
    asked = spark.createDataFrame([("l", "lib::counts"), ("l", "lib::Filtered::next"), ("l", "lib::next"), ("l", "gone"), ("k", "helper")], "library string, path string")
    found = {(r["library"], r["path"]): r["refusal"] or r["callable_id"] for r in derivation.derive_paths(asked, callables, out).collect()}
    assert found == {("l", "lib::counts"): 0, ("l", "lib::Filtered::next"): 3, ("l", "lib::next"): "no-implementation", ("l", "gone"): "no-implementation", ("k", "helper"): 16}


def test_long_delegations_and_deep_terms_are_refused(spark):
    chain = [("l", i, f"f{i}", None, "a", _call(f"f{i + 1}")) for i in range(6)] + [("l", 6, "f6", None, "a", _walk("go"))]
    deep = T.Form("free", 0)
    for _ in range(40):
        deep = T.Form("traverse", None, (deep, T.Form("local", 1)), (T.Pattern("bind", 1),))
    _, _, got = _derived(spark, [*chain, ("l", 7, "deep", None, "a", deep)])
    assert got[0] == ([0, 1, 2, 3, 4], "not-comparable") and got[2] == ([2, 3, 4, 5, 6], str(_walk("go"))) and got[7][1] == "too-deep"
    assert _derived(spark, [])[2] == {}


def brute_derive(table, declared, i):
    """The same by one callable at a time."""
    by = {r[1]: r for r in table}
    contract = derivation.CONTRACT_METHODS["rust"]

    def resolve(me, name):
        same = [r for r in table if r[0] == me[0] and r[2] == name and r[1] != me[1]]
        held = [r for r in same if me[3] is not None and r[3] == me[3]]
        return next((x[0][1] for x in (held, same) if len(x) == 1), None)

    def principal(me):
        t = T.constructed_type(me[5])
        t = me[3] if t == "Self" else t
        if t is None:
            return None
        all_ = [r for r in table if r[0] == me[0] and r[3] == t]
        some = [r for r in all_ if r[4] == me[4]]
        if not some:
            some = all_ if len({d[2] for d in declared if d[:2] == (me[0], t)}) == 1 else []
        some = [r for r in some if r[5] is not None and r[2] in contract]
        return max(some, key=lambda r: (-contract.index(r[2]), T.describes_work(r[5]), T.metrics(r[5])["size"], r[1]))[1] if some else None

    chain = [i]
    for _ in range(4):
        me = by[chain[-1]]
        if me[5] is None or T.describes_work(me[5]):
            break
        target = T.delegation_target(me[5])
        to = resolve(me, target) if target else None
        to = principal(me) if to is None else to
        if to is None or to in chain:
            break
        chain.append(to)
    me = by[chain[-1]]
    if me[5] is not None and not T.describes_work(me[5]) and (to := principal(me)) is not None:
        chain.append(to)
    return chain


def test_derivation_against_one_callable_at_a_time(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, _walk("go"), _found("ok"), *[_call(n) for n in ("f", "g", "h", "next")] * 2, *[T.Form("construct", t) for t in ("A", "B", "Self")] * 2])
    table = [(rng.choice("lk"), i, rng.choice(["f", "g", "h", "i", "next", "poll", *[f"u{i}"] * 6]), rng.choice([None, "A", "B"]), rng.choice("xyz"), pick()) for i in range(60)]
    declared = [("l", "A", "x"), ("l", "B", "x"), ("l", "B", "y"), ("k", "B", "z")]
    _, _, got = _derived(spark, table, declared)
    assert {i: c for i, (c, _) in got.items()} == {r[1]: brute_derive(table, declared, r[1]) for r in table}
    assert max(len(c) for c, _ in got.values()) > 2


# --- catalogs, evidence, observed calls


def test_behaviours_meet_the_first_catalog_of_their_source(spark):
    b = spark.createDataFrame([(1, "p", "1", "d"), (2, "p", "2", "d"), (3, None, "1", "d")], "id int, package string, version string, source_sha256 string")
    c = spark.createDataFrame([(8, "p", "1", "d"), (7, "p", "1", "d"), (6, "p", "2", "other"), (5, None, "1", "d")], "catalog_id int, package string, version string, source_sha256 string")
    assert [(r["id"], r["catalog_id"]) for r in derivation.with_catalog(b, c).collect()] == [(1, 7)]


def test_delegations_among_equal_forms(spark):
    b = spark.createDataFrame([("f", "a::x", ["x", "y"]), ("f", "a::y", ["y"]), ("f", "b::y", ["y", "y"]), ("g", "a::z", ["z", "y"]), ("f", "a::w", [])], "form string, path string, chain array<string>")
    assert {r["path"]: r["n_delegating"] for r in derivation.delegated_to(b).collect()} == {"a::x": 0, "a::y": 2, "b::y": 1, "a::z": 0, "a::w": 0}


def test_evidence_of_a_trace_is_ordered_and_single(spark):
    t = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["gone"]), (3, [])], "trace_id int, paths array<string>")
    e = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_sha256 string")
    got = {r["trace_id"]: [tuple(x) for x in r["inputs"]] for r in effects.with_inputs(t, e).collect()}
    assert got == {1: [("a", "1"), ("b", "2")], 2: [], 3: []}


def test_observed_edges_without_ends(spark):
    edges = spark.createDataFrame([(1, "a", "s", ["b"]), (2, "zz", "s", ["b"]), (3, "a", "s", []), (4, "a", "s", None), (5, "a", "s", ["far", "b"]), (6, "a", "s", ["far"]), (7, "b", "s", ["far", "std::fs::read"])], "edge_id int, from string, span string, to array<string>")
    defs = spark.createDataFrame([("a",), ("b",)], "id string")
    catalog = spark.createDataFrame([("std::fs::read", ["file-read"])], "path string, effects array<string>")
    assert effects.observed_accounting(edges, defs, catalog).first().asDict() == {"total": 7, "linked_internal": 2, "known_effect_origins": 1, "constructors": 0, "outside_selected_corpus": 1, "dynamic_or_ambiguous": 2, "unknown": 1}
    got = {r["edge_id"]: r["message"] for r in effects.observed_diagnostics(edges, defs).collect()}
    assert got == {2: "call from unobserved definition zz", 3: "call in a was resolved to no destination", 4: "call in a was resolved to no destination"}


def test_return_types_by_region(spark):
    region = "file_id int, start int, end int"
    c = spark.createDataFrame([(1, 0, 9, 5), (1, 0, 9, 4), (1, 2, 9, 6), (2, 0, 9, 7)], f"{region}, callable_id int")
    r = spark.createDataFrame([(1, 0, 9, 1, "Option<T>"), (1, 0, 9, 2, "Result<T>"), (2, 0, 9, 1, "Option<T>")], f"{region}, at int, declared string")
    got = {x["callable_id"]: x["containment"] for x in errors.with_containment(c, r, ["Result"], ["Option"]).collect()}
    assert got == {4: "fallible", 6: "infallible", 7: "optional"}


def test_analyzer_digests_frame_their_inputs():
    import hashlib

    got = packs.analyzer_digest("tag-v1", [("a", b"xy"), ("b", b"")])
    assert got == "sha256:" + hashlib.sha256(b"tag-v1\0" + b"\0\0\0\0\0\0\0\1a" + b"\0\0\0\0\0\0\0\2xy" + b"\0\0\0\0\0\0\0\1b" + bytes(8)).hexdigest()
    assert got != packs.analyzer_digest("tag-v1", [("ax", b"y"), ("b", b"")])


def test_replaced_tables_keep_their_last_states(spark, tmp_path):
    schema = "path string, domain string, text string, version long"
    table = TokenTable(spark, str(tmp_path / "t"), trees.tokenize)
    assert table.read() is None and table.versions() == {}
    for v, text in enumerate(["fn a() {}", "fn b() {}", "fn c() {}", "fn d() {}"]):
        table.upsert(spark.createDataFrame([("a.rs", "rust", text, v), ("a.rs", "rust", "fn A() {}", v)], schema))
    assert "d" in {r["lexeme"] for r in table.read().collect()}, "of equal versions the greatest text counts"
    before = rows(table.read())
    table.vacuum()
    assert rows(table.read()) == before and len(list((tmp_path / "t").glob("v-*"))) == 2 and len(list((tmp_path / "t").glob("current-*.json"))) == 2
