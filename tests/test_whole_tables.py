"""Queries over whole tables, against brute force on small tables with known rows."""

import pytest

from tessera.plans.registry import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Writes named tables from rows and a schema, and returns their folder."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_containment_compares_whole_sets(spark, tables):
    # parts 1 and 41 are alike modulo 40; no row has quantity 1 or line number 1
    lines = [(1, 1, 10, 2, 30), (1, 2, 10, 3, 9), (2, 41, 20, 2, 50), (3, 1, 20, 4, 8), (3, 2, 30, 5, 9), (4, 7, 30, 2, 12), (4, 7, 10, 3, 12)]
    d = tables(lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity long"))
    orders, suppliers = {}, {}
    for order, part, supplier, *_ in lines:
        orders.setdefault(order, set()).add(part)
        suppliers.setdefault(supplier, set()).add(part)
    want = sorted((o, s) for o, a in orders.items() for s, b in suppliers.items() if a <= b)
    assert sorted((r.small, r.large) for r in QUERIES["j34_set_containment"](spark, d).collect()) == want
    assert want == [(1, 10), (2, 20), (3, 10), (4, 10), (4, 30)]


def test_every_type_is_asked_for_a_mapping(spark):
    from tessera.plans.link_queries import tokens_of_types
    from tessera.sources.fact_tables import facts

    sf = "/root/testdata/sf0.001"
    types = {r.id for r in facts(spark, sf).nodes.where("kind = 'Type'").collect()}
    assert {r.id for r in tokens_of_types(spark, sf).collect()} == types
    got = {r.id for r in QUERIES["j45_propose_mappings"](spark, sf).collect()}
    assert {i.split(":")[0] for i in got} == {"customer", "supplier"}


def test_every_mention_of_every_part_is_bound_or_not(spark):
    sf = "/root/testdata/sf0.001"
    parts = [(r.p_partkey, r.p_name.replace(" ", "_")) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    bound = {r.m: (r.step, r.anchors) for r in QUERIES["j27_bind_mentions"](spark, sf).collect()}
    assert {m: n for m, n in bound.items() if n[0] == 2 and m in {s for _, s in parts}} == {m: (2, sum(s == m for _, s in parts)) for _, m in parts}
    assert {step for step, _ in bound.values()} == {0, 1, 2, 3, 4}
    said = {(r.page, r.mention): (r.kind, r.anchors, r.drifts) for r in QUERIES["j28_doc_drift"](spark, sf).collect()}
    assert {p for p, _ in said} == {k for k, _ in parts}
    assert all(not anchors for _, anchors, drifts in said.values() if drifts)
    assert {m.rsplit(".")[-1] for (_, m), (_, _, drifts) in said.items() if drifts} == {"yaml", "x", "py"}
    assert not any(drifts for (_, m), (_, _, drifts) in said.items() if m.startswith(("/", "LIMIT_")) or m == "main")
    links = {(r.page, r.symbol) for r in QUERIES["j26_link_docs"](spark, sf).collect()}
    assert links and {p for p, _ in links} <= {k for k, _ in parts}


def test_intents_come_from_every_blame_line(spark):
    from tessera.sources.fact_tables import facts

    sf = "/root/testdata/sf0.001"
    blame = {(f"src/parts/p{r.l_partkey % 40}.py", r.l_linenumber * 9, f"T-{r.l_orderkey % 30}") for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    want = set()
    for n in facts(spark, sf).nodes.where("kind = 'Function' AND file IS NOT NULL").collect():
        want |= {(n.id, issue) for file, line, issue in blame if file == n.file and n.line <= line <= (n.end_line or n.line)}
    assert {(r.symbol, r.issue) for r in QUERIES["j30_intents"](spark, sf).collect()} == want


def test_findings_are_scored_over_all_lines_and_islands(spark, tables):
    import random

    r = random.Random(7)
    rows = [(r.randrange(2_000), r.randrange(3), r.randrange(2, 8), "RA"[r.randrange(2)]) for _ in range(600)]
    d = tables(lineitem=(rows, "l_orderkey long, l_suppkey long, l_linenumber long, l_returnflag string"))
    want = []
    for file in range(3):
        ours = sorted(k % 400 for k, f, _, flag in rows if f == file and flag == "R")
        used = set()
        for line in sorted(k % 400 for k, f, _, flag in rows if f == file and flag == "A"):
            hit = next((k for k, at in enumerate(ours) if k not in used and abs(at - line) <= 3), None)
            used.add(hit)
            want.append((str(file), line, None if hit is None else ours[hit]))
    got = [(x.file, x.line, x.found) for x in QUERIES["j62_score_findings"](spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[2] is None for w in want)


def test_no_row_of_the_tables_goes_without_a_result(spark):
    sf = "/root/testdata/sf0.001"
    lines, orders = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert QUERIES["f31_confidence_bands"](spark, sf).count() == lines
    assert QUERIES["s57_added_lines"](spark, sf).count() == 2 * lines
    names = {f"order_{r.o_orderkey}" for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    assert {r.k for r in QUERIES["j43_design_references"](spark, sf).collect()} == {k for n in names if (k := f"order_{int(n[6:]) * 2}") not in names} and len(names) == orders
    sf = "/root/testdata/sf0.01"
    external = {f"customer:{r.c_custkey}": r.c_acctbal < 0 for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    sides = QUERIES["j25_entity_resolution"](spark, sf).collect()
    assert sides and all(not external[r.orm] and external[r.db] for r in sides)
    assert len({r.orm[-1] for r in sides}) > 2


def test_a_drained_stream_is_read_from_files(spark, tmp_path):
    from tessera.streaming import tail as S

    spark.range(20).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 3 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").repartition(3).write.parquet(str(tmp_path / "events"))
    rows = S.drain(S.tail(spark, str(tmp_path / "events")), "from_files")
    daily = S.drain(S.windowed(S.tail(spark, str(tmp_path / "events"))), "from_files_daily", "complete")
    assert rows.count() == 20 and rows.inputFiles()
    assert [r.n for r in daily.collect()] == [20] and daily.inputFiles()
    assert S.drain(S.tail(spark, str(tmp_path / "events")).where("event_id < 0"), "none").count() == 0


def test_components_are_labelled_apart_and_numbered_together(spark, monkeypatch):
    from tessera.plans import graph_queries as G

    parts, real = [], G.T.components
    monkeypatch.setattr(G.T, "components", lambda nodes, links: parts.append(real(nodes, links)) or parts[-1])
    edges = [("a", "m", 1), ("b", "n", 1), ("d", "n", 3)]
    got = G.label_propagation(G.undirected(spark.createDataFrame(edges, "src_area string, dst_area string, weight long")))
    assert {r.node: r.community for r in got.collect()} == {"a": 0, "m": 0, "b": 1, "n": 1, "d": 1}
    assert len({r.component for r in parts[0].collect()}) == 2


def test_large_components_go_by_turns_with_the_same_result(spark):
    import random

    from tessera.operators.communities import by_turns, label_propagation

    rng = random.Random(3)
    edges = {(a, b): rng.choice((1, 1, 2, 5)) for a, b in (sorted(rng.sample(range(11), 2)) for _ in range(14))}
    both = [(f"n{x:02d}", f"n{y:02d}", w) for (a, b), w in edges.items() for x, y in ((a, b), (b, a))]
    both += [("n03", "n03", 2), ("z", "z", 1)]  # nodes that are their own neighbours
    u = spark.createDataFrame(both, "a string, b string, weight long")
    grouped, turns = ({r.node: r.community for r in label_propagation(u, group_hops=most).collect()} for most in (1_000, 2))
    assert grouped == turns and len(set(grouped.values())) > 1
    assert by_turns(u.limit(0), 20).count() == 0
