"""The store end to end: versions, upsert, searches, facets, duplicates, proofs, staleness, ingest; limiter and helpers."""

import json
import time

import pytest
from pyspark.sql import functions as F

import axiomata
from axiomata import cli
from axiomata import config as settings
from axiomata.functions import features, strings
from axiomata.functions.canonical import canonical
from axiomata.functions.expressions import parse
from axiomata.operators import api, limiter, search
from axiomata.operators import store as stores
from axiomata.operators.scratch import shared_dir
from axiomata.operators.store import Changed, Store
from axiomata.sources import corpus
from axiomata.streaming.ingest import ingest_stream

#: A small corpus: id, left side, right side.
CORPUS = [
    ("heat-1", "Exp[-k*t]*Sin[k*x]", ""),
    ("heat-2", "Sin[m*y]*Exp[-m*s]", "u"),
    ("wave-1", "Cos[w*t] + Sin[w*t]", "Sqrt[2]*Cos[w*t - Pi/4]"),
    ("series-1", "Sum[Binomial[n, j], {j, 0, n}]", "2^n"),
    ("area-1", "Integrate[Sqrt[1 - r^2], {r, -1, 1}]", "Pi/2"),
]


def entries(*rows):
    return [{"id": k, "source": "book", "class": "formula", "lhs": left, "rhs": right} for k, left, right in rows]


def write(path, rows):
    path.write_text(json.dumps(rows))
    return str(path)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """A store of CORPUS, read only by the tests that take it."""
    folder = tmp_path_factory.mktemp("filled")
    made = Store(spark, f"file://{folder}/store")
    made.ingest([write(folder / "all.json", entries(*CORPUS))])
    return made


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store")
    made.reset()
    return made


def keys(df):
    return sorted((r["entry_id"], r["side"]) for r in df.collect())


# versions


def test_pointers_are_numbered_and_complete(spark, store, tmp_path):
    store.add({"id": "one", "lhs": "u + 1"})
    before = store.version.number
    (tmp_path / "store" / f"VERSION-{before + 1:010d}").write_text('{"segments": {"formulas": ["gone"]')  # a writer that broke off
    again = Store(spark, store.root)
    assert again.count() == 1
    again.add({"id": "two", "lhs": "u + 2"})
    assert again.count() == 2 and again.version.number > before + 1


def test_data_without_a_pointer_is_not_taken_for_an_empty_store(spark, store, tmp_path):
    store.add({"id": "one", "lhs": "u + 1"})
    for f in (tmp_path / "store").glob("VERSION-*"):
        f.unlink()
    with pytest.raises(ValueError, match="no complete pointer"):
        Store(spark, store.root)


def test_of_two_writers_one_fails(spark, store):
    begun = store.version
    store.add({"id": "one", "lhs": "u + 1"})
    with pytest.raises(Changed):
        store._publish(stores.Version(begun.number + 1, begun.segments, begun.meta))
    assert store.count() == 1


def test_one_entry_writes_one_segment(store, tmp_path, monkeypatch):
    store.add({"id": "a", "lhs": "u + 1", "rhs": "u*v"})
    first = store.version.segments["formulas"]
    store.add({"id": "a", "lhs": "Gamma[u]"})
    assert store.version.segments["formulas"][:-1] == first
    assert keys(store.formulas) == [("a", "lhs"), ("a", "rhs")]
    assert [r["facet"] for r in store.table("facets").collect()] == ["gamma-function"]
    assert {r["tok"] for r in store.table("postings").where("side = 'lhs'").collect()} == set(features.tokens_from("Gamma[v0]"))
    monkeypatch.setattr(stores, "MOST", 2)
    store.add({"id": "b", "lhs": "Zeta[u]"})
    assert len(store.version.segments["formulas"]) == 1
    assert keys(store.formulas) == [("a", "lhs"), ("a", "rhs"), ("b", "lhs")]
    assert sorted(r["facet"] for r in store.table("facets").collect()) == ["gamma-function", "zeta"]


def test_searches_read_the_index_tables(filled):
    for plan in (filled.table("facets").where("facet = 'sum'"), filled.table("postings").where("tok = 'op:Sum'")):
        assert "PushedFilters: [IsNotNull" in plan._jdf.queryExecution().executedPlan().toString()


# searches


def test_exact_search_ignores_names_and_order(filled):
    hit = filled.exact("Exp[-a*b]*Sin[c*a]").collect()
    assert [(o["entry_id"], o["side"]) for o in hit[0]["occurrences"]] == [("heat-1", "lhs"), ("heat-2", "lhs")]
    assert (len(hit), hit[0]["entry_id"], hit[0]["score"], hit[0]["identity_mma"]) == (1, "heat-1", 1.0, "Exp[-k*t]*Sin[k*x]")
    assert hit[0]["identity_latex"] == r"e^{-k t} \sin\!\left(k x\right)"
    assert filled.exact("Exp[a*b]*Sin[c*a]").count() == 0


def test_fuzzy_search_ranks_by_likeness(filled):
    tokens = features.tokens_from(canonical(parse("Sum[Binomial[m, i]^2, {i, 0, m}]")))
    rows = filled.fuzzy(tokens, 3, 50).collect()
    assert rows[0]["entry_id"] == "series-1" and len(rows) <= 3
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    with_index = [(r["entry_id"], r["side"], r["score"]) for r in rows]
    without = [(r["entry_id"], r["side"], r["score"]) for r in search.fuzzy(filled.formulas, tokens, 3, 50).collect()]
    assert with_index == without
    assert filled.fuzzy([], 3, 50).count() == filled.fuzzy(tokens, 0, 50).count() == 0
    with pytest.raises(ValueError):
        filled.fuzzy(tokens, -3, 50)
    assert [search.pool_for(10, 5), search.pool_for(10, 70)] == [50, 70]


def test_facets_narrow_step_by_step(filled):
    def counted(selected, limit=25):
        found = filled.facets(selected, limit)
        return found.total.first()["total"], {r["facet"]: r["n"] for r in found.refine.collect()}, keys(found.hits)

    total, refine, hits = counted(["trigonometric"])
    assert (total, hits) == (4, [("heat-1", "lhs"), ("wave-1", "lhs"), ("wave-1", "rhs")])  # heat-2 is an occurrence of heat-1
    assert "trigonometric" not in refine and refine["has-e"] == 2
    total, refine, hits = counted(["trigonometric", "square-root"])
    assert (total, hits) == (1, [("wave-1", "rhs")])
    assert counted(["trigonometric"], 3)[2] == []
    assert counted([])[0] == 9
    assert counted(["trigonometric", "trigonometric"])[0] == 4
    assert search.facets(filled.formulas, ["sum", "sum"], 9, strict=True).total.first()["total"] == 0
    assert counted(["no-such-facet"]) == (0, {}, [])


def test_duplicates_and_their_report(filled):
    total, groups = filled.duplicates(5)
    line = search.duplicate_report(groups).first()["line"]
    assert total == 1 and line.endswith(" ×2 heat-1.lhs, heat-2.lhs") and len(line.split(" ")[0]) == 12
    assert filled.duplicates(0)[1].count() == 0


def test_replacing_a_side_ends_a_duplicate(store):
    store.add({"id": "p", "lhs": "u^2 + v"})
    store.add({"id": "q", "lhs": "s + r^2"})
    assert store.duplicates()[0] == 1
    store.add({"id": "q", "lhs": "s + r^3"})
    assert (store.duplicates()[0], store.count()) == (0, 2)


# service


def test_service_answers(store):
    assert api.stats(store).first()["count"] == 0
    signatures = api.add(store, {"id": "z", "lhs": "Zeta[2]", "rhs": "Pi^2/6"}).first()["signatures"]
    assert sorted(signatures) == ["lhs", "rhs"]
    found = api.search(store, "Zeta[2]")
    assert found["query_canonical"] == "Zeta[#2]" and "warning" not in found
    assert found["exact"].first()["identity_mma"] == "Zeta[2] == Pi^2/6"
    assert found["fuzzy"].columns == list(api.HIT)
    assert set(api.search(store, "Zeta[")) == {"error"}
    with pytest.raises(ValueError):
        api.search(store, "")
    given = api.facets(store, ["has-pi"])
    assert (given["selected"], given["limit"], given["total"].first()["total"], given["hits"].first()["side"]) == (["has-pi"], 25, 1, "rhs")
    api.put_proof(store, "z", "coq", "by computation")
    assert tuple(api.get_proof(store, "z").first()) == ("z", "coq", "draft", "by computation")
    store.set_meta("engine_probe", "of another engine")
    assert "stale" in api.search(store, "Zeta[2]")["warning"]


def test_entries_are_added_whole_or_not_at_all(store):
    for bad in ({"lhs": "u"}, {"id": "x"}, {"id": "x", "lhs": "u", "rhs": "v["}):
        with pytest.raises(ValueError):
            store.add(bad)
    assert store.count() == 0


def test_proofs_are_replaced_and_outlive_a_reset(store):
    store.set_proof("t", "agda", b"first", "checked")
    store.set_proof("t", "agda", b"second")
    store.set_proof("s", "isabelle", b"\x00\xff")
    store.reset()
    assert [tuple(r) for r in store.proof("t").select("system", "status", F.decode("proof", "UTF-8")).collect()] == [("agda", "draft", "second")]
    assert bytes(store.proof("s").first()["proof"]) == b"\x00\xff"
    assert store.table("proofs").where("updated is null").count() == 0
    assert store.proof("r").count() == 0
    for system, proof in (("", b"p"), ("agda", b"")):
        with pytest.raises(ValueError):
            store.set_proof("t", system, proof)


def test_a_stale_store_is_ingested_afresh(spark, tmp_path, store):
    store.add({"id": "old", "lhs": "u"})
    store.set_meta("schema_version", "0")
    assert store.stale() == (True, "schema version 0, not 2")
    store.ingest([write(tmp_path / "new.json", entries(("new", "v", "")))])
    assert store.stale() == (False, "") and keys(store.formulas) == [("new", "lhs")]
    assert store.meta("nothing") == ""


# sources


def test_paths(spark, tmp_path, monkeypatch):
    for name in ("b.json", "a.json", "notes.txt", "below/c.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("[]")
    assert corpus.expand([str(tmp_path)]) == [f"{tmp_path}/a.json", f"{tmp_path}/b.json"]
    assert corpus.expand([f"{tmp_path}/*.txt", f"{tmp_path}/a.json", f"{tmp_path}/a.json"]) == [f"{tmp_path}/a.json"] * 2 + [f"{tmp_path}/notes.txt"]
    remote = corpus.expand([f"file://{tmp_path}", f"file://{tmp_path}/*.txt"], spark)
    assert [p.rsplit("/", 1)[1] for p in remote] == ["a.json", "b.json", "notes.txt"]
    monkeypatch.setenv("HOME", str(tmp_path))
    assert corpus.expand(["~/a.json"]) == [f"{tmp_path}/a.json"]
    assert corpus.expand_home("~other/a") == "~other/a"
    for missing in ([f"{tmp_path}/none"], ):
        with pytest.raises(FileNotFoundError):
            corpus.expand(missing)
    with pytest.raises(FileNotFoundError):
        corpus.expand([f"file://{tmp_path}/none"], spark)
    assert corpus.sources([], [f"{tmp_path}/b.json"]) == [f"{tmp_path}/b.json"]
    with pytest.raises(ValueError):
        corpus.sources([], [])


def test_ingest_skips_files_whole_and_rejects_sides(spark, tmp_path, store):
    good = write(tmp_path / "1.json", [{"id": "g", "lhs": "u*(v", "rhs": "w", "unknown": [1]}, {"id": "h", "lhs": "  ", "rhs": "v^2"}, {"id": "g", "rhs": "w + 1"}])
    wrong = [write(tmp_path / "2.json", {"id": "x", "lhs": "u"}), write(tmp_path / "3.json", [{"id": "x", "lhs": 1}]), write(tmp_path / "4.json", ["x"])]
    done = store.ingest([good, *wrong])
    assert (done.total, done.indexed, done.rejected.count(), done.skipped.count()) == (4, 3, 1, 3)
    assert tuple(done.rejected.first())[:3] == ("g", "lhs", "u*(v")
    assert {(r["entry_id"], r["side"]): r["mma"] for r in store.formulas.collect()} == {("g", "rhs"): "w + 1", ("h", "rhs"): "v^2"}
    held = sorted(map(str, store.formulas.collect()))
    store.ingest([good])
    assert sorted(map(str, store.formulas.collect())) == held


def test_ingest_of_arriving_files(spark, tmp_path, store):
    folder = tmp_path / "arriving"
    folder.mkdir()
    write(folder / "1.json", entries(("k", "u", ""), ("l", "v", "")))
    write(folder / "2.json", entries(("k", "u + 1", "")))
    (folder / "3.json").write_text("not json")
    query = ingest_stream(spark, f"file://{folder}", store, f"file://{tmp_path}/checkpoint")
    assert query.awaitTermination(180)
    assert {r["entry_id"]: r["mma"] for r in store.formulas.collect()} == {"k": "u + 1", "l": "v"}


def test_command_line(spark, tmp_path, capsys):
    at = ["-store", f"file://{tmp_path}/store"]
    said = lambda *argv: (cli.run(spark, [*at, *argv]), *capsys.readouterr())
    assert said("ingest", write(tmp_path / "c.json", entries(*CORPUS)))[1].startswith("indexed 9 of 9 formulas, 0 not parsed; 9 stored")
    assert "series-1.rhs" in said("search", "2", "^", "k")[1]
    assert said("search", "2^")[0] == 1
    assert "1 formulas" in said("facets", "sum")[1]
    assert "heat-1.lhs, heat-2.lhs" in said("dedup")[1]
    (tmp_path / "proof").write_bytes(b"qed")
    assert said("proof", "-set", str(tmp_path / "proof"), "-system", "hol", "wave-1")[0] == 0
    assert "hol draft\nqed" in said("proof", "wave-1")[1]
    assert said("proof", "wave-2")[0] == 1
    assert said("stats")[1] == "9\n"
    assert said("version")[1].startswith(f"axiomata {axiomata.__version__}, schema 2")
    Store(spark, at[1]).set_meta("engine_probe", "another")
    assert "stale" in said("facets", "sum")[2]


def test_settings(tmp_path, monkeypatch):
    path = write(tmp_path / "c.json", {"search": {"fuzzy_limit": 40, "pool": 20, "more": 1}, "store": "of the file", "corpus": {"roots": ["x"]}, "server": {"read_timeout": 9}})
    found = settings.load(path)
    assert (found.search.fuzzy_limit, found.search.pool, found.store, found.corpus.roots, found.server.read_timeout, found.rate_limit.rpm) == (40, 200, "of the file", ("x",), 9, 60)
    monkeypatch.setenv("AXIOMATA_STORE", "of the environment")
    assert settings.load(path).store == "of the environment"
    assert settings.load(path, store="of a flag", fuzzy_limit=3, pool=4).search.pool == 4
    assert settings.load(path, store="of a flag").store == "of a flag"


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError):
        shared_dir(Far)
    assert shared_dir(spark)


# limiter


def requests(spark, rows):
    return spark.createDataFrame(rows, "i long, who string, at double, path string, role string").withColumn("ts", F.timestamp_seconds("at"))


def test_limiter_refills_and_spares(spark):
    rate, burst = limiter.per_minute(30, 3)
    rows = [(i, "a", 50.0, "/api/x", "social") for i in range(5)] + [(5, "a", 54.0, "/api/x", "social"), (6, "a", 54.0, "/api/x", "social"), (7, "a", 54.0, "/api/x", "social")]
    rows += [(10 + i, "p", 50.0, "/api/x", "privileged") for i in range(6)] + [(20 + i, "b", 50.0, "/docs", None) for i in range(6)]
    spared = limiter.exempt(F.col("path"), F.col("role"))
    found = {r["i"]: r["allowed"] for r in limiter.limited(requests(spark, rows), "who", "ts", "i", rate, burst, spared).collect()}
    assert [found[i] for i in range(8)] == [True, True, True, False, False, True, True, False]
    assert all(found[i] for i in found if i >= 10)
    strict = limiter.exempt(F.col("path"), F.col("role"), privileged=False)
    found = {r["i"]: r["allowed"] for r in limiter.limited(requests(spark, rows), "who", "ts", "i", rate, burst, strict).collect()}
    assert [found[10 + i] for i in range(6)] == [True, True, True, False, False, False]
    assert (limiter.per_minute(-1, 5), limiter.per_minute(90, 0)) == ((1, 5), (1.5, 90))


def test_limiter_of_a_stream(spark, tmp_path):
    from axiomata.streaming import limiter as streaming

    rows = requests(spark, [(i, "ab"[i % 2], 9.0 + i / 100, "", "") for i in range(8)])
    rows.write.parquet(f"{tmp_path}/in")
    stream = streaming.limited(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "who", "ts", "i", 1.0, 3, idle_ms=None)
    query = stream.writeStream.format("memory").queryName("limits").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r["i"], r["allowed"]) for r in spark.table("limits").collect()) == [(i, i < 6) for i in range(8)]


def test_idle_buckets_are_dropped(spark, tmp_path):
    from axiomata.streaming import limiter as streaming

    rows = requests(spark, [(i, "abc"[i % 3], 9.0, "", "") for i in range(6)])
    rows.write.parquet(f"{tmp_path}/in")
    stream = streaming.limited(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "who", "ts", "i", 1.0, 3, idle_ms=500)
    query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(processingTime="1 second").start()
    held, until = [], time.time() + 90
    while time.time() < until and not (max(held, default=0) == 3 and held[-1] == 0):
        time.sleep(0.5)
        held += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]][len(held) :]
    query.stop()
    assert max(held) == 3 and held[-1] == 0


# helpers


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: strings.bearer(F.lit("Bearer  t0ken ")), "t0ken"),
        (lambda: strings.bearer(F.lit("bearer t0ken")), ""),
        (lambda: strings.client_ip(F.lit("203.0.113.9 ,198.51.100.1"), F.lit("x:1")), "203.0.113.9"),
        (lambda: strings.client_ip(F.lit(""), F.lit("[2001:db8::7]:443")), "2001:db8::7"),
        (lambda: strings.client_ip(F.lit(None).cast("string"), F.lit("198.51.100.1:80")), "198.51.100.1"),
        (lambda: strings.user_info_id(F.lit('{"sub": "", "id": "77"}')), "77"),
        (lambda: strings.user_info_id(F.lit('{"name": "n"}')), None),
        (lambda: strings.id_token_subject(F.lit("aa.eyJzdWIiOiJ4eSJ9.cc")), "xy"),
        (lambda: strings.id_token_subject(F.lit("aa.eyJzdWIiOiJ4eSJ9")), None),
        (lambda: strings.cleaned_latex(F.lit("  $$u^2$$  ")), "u^2"),
        (lambda: strings.cleaned_latex(F.lit("$u^2$.")), "u^2$"),
        (lambda: strings.cleaned_latex(F.lit("$u^2 , $")), "u^2"),
        (lambda: strings.shortened(F.lit("abcdef"), 4), "abcd…"),
        (lambda: strings.display_latex(F.lit(""), F.lit("l")), "l"),
        (lambda: strings.display_mma(F.lit(None).cast("string"), F.lit(None).cast("string")), ""),
        (lambda: strings.subject(F.lit("idp"), F.lit("me")), "idp:me"),
    ],
)
def test_strings(spark, made, want):
    assert spark.range(1).select(made().alias("x")).first()["x"] == want
