"""Repositories and datasets, indexed and searched end to end."""

import subprocess

import pytest
from pyspark.sql import functions as F

from lodeseek import cli
from lodeseek.config import load_config, parse_override
from lodeseek.errors import EmptyQueryError, IndexNotFoundError, InvalidCommitError, LodeseekError, MissingEmbeddingsError, ModelLoadError, RepositoryNotFoundError
from lodeseek.plans import experiments
from lodeseek.plans.index import index_repository
from lodeseek.plans.search import Engine, Options, retrieve
from lodeseek.sources.dataset import Dataset, last_turns, read_dataset, titled, write_dataset
from lodeseek.sources.repository import folder_snapshot, list_files, read_files, take_snapshot

FILES = {
    "tidy.py": "def tidy_address(line):\n    short = line.replace('Street', 'St').title()\n    return deliver(short)\n\ndef deliver(parcel):\n    return dispatch(parcel)\n\ndef dispatch(cargo):\n    lorry.load(cargo)\n",
    "vault.py": "def open_vault(owner, pin):\n    ticket = hmac.new(pin, owner).hexdigest()\n    return ticket\n\ndef check_ticket(ticket):\n    return hmac.compare_digest(ticket, STORED)\n",
    "pump.py": "def pump_water(tank):\n    for stroke in range(5):\n        if tank.full():\n            return stroke\n        wait_for_pressure(3 * stroke)\n",
    "score.py": "def judge_jump(height):\n    if above(BAR, height):\n        return points(BAR, height)\n",
}


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("code")
    repo = folder / "repo"
    write(repo, FILES | {"README.md": "# no code", "node_modules/x.js": "function skipped() {\n}\n", "huge.py": "x = 1\n" * 1000, "broken.py": "def broken(:\n"})
    config = load_config(overrides={"index.dir": str(folder / "index"), "embedding_model.lsa_dim": 8, "chunking.max_file_bytes": 4000})
    return repo, config, index_repository(spark, str(repo), config=config)


def top(engine, text, k=3, **options):
    return engine.search(engine.queries(text), top_k=k, **options).orderBy("query_id", "rank").collect()


def test_folder_counters(indexed):
    _, _, stats = indexed
    assert (stats["label"], stats["commit"], stats["files_supported"], stats["files_large"]) == ("worktree", "WORKTREE", 6, 1)
    assert stats["files_total"] == 7 and stats["chunks"] == 8 and stats["embeddings_computed"] == 8


def test_expected_units_come_first(spark, indexed):
    repo, config, _ = indexed
    engine = Engine(spark, repo.name, config)
    assert top(engine, "Which step shortens the address line of a parcel?")[0].function == "tidy_address"
    assert top(engine, "wait until there is pressure on the water tank")[0].function == "pump_water"
    first = top(engine, "open_vault hmac ticket")[0]
    assert first.function == "open_vault" and first.why.startswith("[FUNCTION_LOOKUP] defines a queried identifier") and "identifier" in first.method
    both = top(engine, ["pressure on the water tank", "open_vault hmac ticket"], 1)
    assert [r.function for r in both] == ["pump_water", "open_vault"]
    assert retrieve(spark, "compare the hmac digest", repo.name, top_k=1, config=config).first().file == "vault.py"


def test_channels_can_be_switched_off(spark, indexed):
    repo, config, _ = indexed
    engine = Engine(spark, repo.name, config)
    assert all(r.method == "bm25" for r in top(engine, "hmac ticket digest", options=Options(use_dense=False, use_identifier=False, use_rerank=False)))
    assert all(r.method == "dense" for r in top(engine, "hmac ticket digest", options=Options(use_bm25=False, use_identifier=False, use_rerank=False)))
    rrf = Engine(spark, repo.name, load_config(overrides={"index.dir": config["index"]["dir"], "retrieval.fusion": "rrf"}))
    assert top(rrf, "is the ticket of the vault right")[0].function in {"check_ticket", "open_vault"}


def test_structural_feature(spark, indexed):
    repo, config, _ = indexed
    engine = Engine(spark, repo.name, config)
    rows = engine.featured(engine.understand(engine.queries("what reaches the dispatch function")), engine._tables("worktree"), Options(), ("function",))
    assert {r.function: r.structural for r in rows.collect()}["deliver"] == 1.0


def test_a_batch_too_large_to_be_sent_around_has_the_same_results(spark, indexed, monkeypatch):
    repo, config, _ = indexed
    engine = Engine(spark, repo.name, config)
    texts = ["pressure on the water tank", "open_vault hmac ticket", "what reaches the dispatch function"]
    want = [tuple(r)[:6] for r in top(engine, texts, 5)]
    from lodeseek.plans import search

    monkeypatch.setattr(search, "SMALL_BATCH", 0)
    assert [tuple(r)[:6] for r in top(engine, texts, 5)] == want


def test_another_encoder_and_reranker(spark, tmp_path):
    """Anything with the methods of an encoder, and of a reranker, takes part."""
    from pyspark.sql import functions as F

    from lodeseek.operators import dense, ranking

    class Letters:
        model_version, dim = "letters-1", 26

        def fit(self, docs):
            return self

        def encode(self, docs, columns=None):
            joined = F.array_join("tokens", "")
            counts = F.array(*(F.length(joined) - F.length(F.translate(joined, chr(97 + i), "")) for i in range(26)))
            return docs.select(*(columns or ["chunk_id"]), F.transform(dense.normalised(counts), lambda x: x.cast("float")).alias("vector"))

    class ByName:
        def rerank(self, rows, top_n):
            return ranking.rerank(rows, F.when(F.col("function") == "check_ticket", 9.0).otherwise(F.col("score")), top_n)

    write(tmp_path / "code", FILES)
    config = load_config(overrides={"index.dir": str(tmp_path / "index")})
    assert index_repository(spark, str(tmp_path / "code"), config=config, encoder=Letters())["embedder"] == "letters-1"
    engine = Engine(spark, "code", config, ByName(), Letters())
    assert top(engine, "water tank pressure", 8)[0].function == "check_ticket"
    with pytest.raises(MissingEmbeddingsError):
        Engine(spark, "code", config).search(engine.queries("x"))
    with pytest.raises(ModelLoadError):
        dense.load_encoder({"backend": "unknown", "fallback_to_lsa": False})


def test_files_that_are_not_utf8_or_not_there(spark, tmp_path):
    """One such file doesn't end a build: bytes are replaced, a missing file and a missing object are left out."""
    (tmp_path / "latin.py").write_bytes("def größe():\n    return 'é'\n".encode("latin-1"))
    write(tmp_path, {"good.py": "def good():\n    return 1\n", "node_modules/deep/x.py": "y = 1\n", "sub/.git/z.py": "z = 1\n"})
    state = folder_snapshot(str(tmp_path))
    files = list_files(spark, state)
    assert {r.path: r.size for r in files.collect()} == {"latin.py": 28, "good.py": 25}
    asked = files.unionByName(spark.createDataFrame([("gone.py", "0" * 40, 1)], files.schema))
    found = {r.file: r.content for r in read_files(state, asked).collect()}
    assert found == {"latin.py": "def gr\ufffd\ufffde():\n    return '\ufffd'\n", "good.py": "def good():\n    return 1\n"}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "latin.py", "good.py")
    git("commit", "-qm", "x")
    state = take_snapshot(str(tmp_path))
    files = list_files(spark, state)
    asked = files.unionByName(spark.createDataFrame([("gone.py", "0" * 40, 1)], files.schema))
    assert {r.file: r.content for r in read_files(state, asked).collect()} == found
    config = load_config(overrides={"index.dir": str(tmp_path / "index")})
    stats = index_repository(spark, str(tmp_path), config=config)
    assert stats["chunks"] == 2 and stats["files_without_chunks"] == 0


def test_errors(spark, indexed, tmp_path):
    repo, config, _ = indexed
    engine = Engine(spark, repo.name, config)
    for text in ("", "  ", None, []):
        with pytest.raises(EmptyQueryError):
            engine.queries(text)
    with pytest.raises(ValueError, match="top_k"):
        engine.search(engine.queries("x"), top_k=0)
    with pytest.raises(IndexNotFoundError):
        engine.search(engine.queries("x"), "no such version")
    with pytest.raises(RepositoryNotFoundError):
        take_snapshot(str(tmp_path / "nowhere"))
    with pytest.raises(InvalidCommitError):
        take_snapshot(str(repo), "abc")
    with pytest.raises(IndexNotFoundError):
        retrieve(spark, "x", "never indexed", config=config)
    write(tmp_path / "texts", {"a.txt": "x"})
    with pytest.raises(LodeseekError):
        index_repository(spark, str(tmp_path / "texts"), config=load_config(overrides={"index.dir": str(tmp_path / "i")}))


def test_vectors_of_another_encoder_are_refused(spark, indexed):
    repo, config, _ = indexed
    engine = Engine(spark, repo.name, config)
    engine.encoder.projection = engine.encoder.projection + 1
    with pytest.raises(MissingEmbeddingsError):
        engine.search(engine.queries("x"))


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Three commits; a function is renamed in each."""
    folder = tmp_path_factory.mktemp("history")
    repo = folder / "project"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    body = '    """Cleans the input."""\n    text = text.strip()\n    return text.lower()\n\ndef tail(x):\n    return x[-1]\n\ndef head(x):\n    return x[0]\n'
    config = load_config(overrides={"index.dir": str(folder / "index"), "embedding_model.lsa_dim": 8})
    stats = []
    for number, name in enumerate(("normalize_input", "preprocess_input", "sanitize_input")):
        write(repo, {"preprocessing.py": f"def {name}(text):\n{body}", "engine.py": "def run(job):\n    return job.start()\n", "notes.txt": "text"})
        if number:
            write(repo, {"checks.py": "def validate_token(t):\n    return jwt.decode(t)\n"})
        git("add", "-A")
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-qm", name], check=True, capture_output=True, env={"GIT_COMMITTER_DATE": f"2024-01-0{number + 1}T00:00:00Z", "PATH": "/usr/bin:/bin:/usr/local/bin"})
        stats.append(index_repository(spark, str(repo), label=f"v{number + 1}", config=config))
    return repo, config, stats


def test_incremental_counters(history):
    _, _, (one, two, three) = history
    assert (one["chunks"], one["embeddings_computed"], one["base"]) == (4, 4, None)
    assert (one["files_total"], one["files_unsupported"], one["files_parsed"], one["files_from_cache"], one["files_without_chunks"]) == (3, 1, 2, 0, 0)
    assert (two["base"], two["files_changed"], two["chunks_reused"], two["embeddings_computed"]) == ("v1", 2, 1, 2)
    assert (three["base"], three["files_changed"], three["chunks_reused"], three["embeddings_computed"]) == ("v2", 1, 2, 1)


def test_incremental_equals_full(spark, history):
    repo, config, _ = history
    columns = ("file", "qualname", "code", "chash", "identity", "start_line")
    engine = Engine(spark, repo.name, config)
    read = lambda label: sorted(map(tuple, engine._tables(label)["chunks"].select(*columns).collect()))
    stats = index_repository(spark, str(repo), label="full", config=config, full=True)
    assert stats["embeddings_computed"] == 0 and stats["chunks_reused"] == 0
    assert read("full") == read("v3")


def test_the_base_can_be_chosen(spark, history, tmp_path):
    repo, config, _ = history
    stats = index_repository(spark, str(repo), label="from-v1", config=config, base="v1")
    assert (stats["base"], stats["files_changed"], stats["chunks_reused"], stats["files_from_cache"]) == ("v1", 2, 1, 2)
    with pytest.raises(IndexNotFoundError):
        index_repository(spark, str(repo), label="x", config=config, base="v9")


def test_each_version_is_searched_alone(spark, history):
    repo, config, _ = history
    engine = Engine(spark, repo.name, config)
    for label, name in (("v1", "normalize_input"), ("v2", "preprocess_input"), ("v3", "sanitize_input"), ("latest", "sanitize_input")):
        assert engine.search(engine.queries("cleans the input"), label, 1).first().function == name
    commit = engine.versions().filter("label = 'v1'").first().commit
    assert engine.search(engine.queries("cleans the input"), commit[:10], 1).first().version == "v1"


def test_all_versions_collapse(spark, history):
    repo, config, _ = history
    engine = Engine(spark, repo.name, config)
    all_ = engine.search(engine.queries("cleans the input"), "all", 30)
    whole = engine.search(engine.queries("cleans the input"), "all", 30, history=True)
    assert all_.count() < whole.count()
    assert len(all_.orderBy("rank").first().also_in) >= 2


def test_many_versions_do_not_crowd_out_other_units(spark, tmp_path):
    """Three versions of four units, and channels of four candidates: all four are found."""
    from lodeseek.plans.index import index_chunks

    config = load_config(overrides={"index.dir": str(tmp_path / "index"), "embedding_model.lsa_dim": 4, "retrieval.bm25_top_k": 4, "retrieval.dense_top_k": 4, "retrieval.identifier_top_k": 4, "retrieval.candidate_size": 4, "ranking.rerank_top_n": 4})
    from lodeseek.sources.chunker import document_chunks

    units = spark.createDataFrame([(f"u{i}", f"def lamp_{'bcde'[i]}(x):\n    return lamp(x)\n") for i in range(4)], "doc_id string, text string")
    for version in range(3):
        own = document_chunks(units).withColumns({"repository": F.lit("many"), "version": F.lit(f"v{version}"), "timestamp": F.lit(float(version))})
        index_chunks(spark, own, "many", f"v{version}", config, float(version))
    engine = Engine(spark, "many", config)
    found = engine.search(engine.queries("lamp"), "all", 10).collect()
    assert {r.doc_id for r in found} == {"u0", "u1", "u2", "u3"} and all(len(r.also_in) == 2 for r in found)


DOCS = [("d1", "def add(a, b): return a + b  # sum of two numbers"), ("d2", "open the database connection with a pool"), ("d3", "parse json configuration from a file"), ("d4", "draw a red circle on the canvas")]


def dataset(spark):
    return Dataset(
        "small",
        spark.createDataFrame(DOCS, "doc_id string, text string"),
        spark.createDataFrame([("q1", "database connection"), ("q2", "red circle canvas")], "query_id string, text string"),
        spark.createDataFrame([("q1", "d2", 1), ("q2", "d4", 1)], "query_id string, doc_id string, rel int"),
    )


def test_dataset_round_trip_and_evaluation(spark, tmp_path):
    write_dataset(dataset(spark), str(tmp_path / "set"))
    again = read_dataset(spark, str(tmp_path / "set"))
    assert again.name == "set" and sorted(map(tuple, again.corpus.select("doc_id", "text").collect())) == DOCS and again.qrels.count() == 2
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, str(tmp_path))
    rows = list(experiments.ablation(spark, again, str(tmp_path / "index"), {k: experiments.PRESETS[k] for k in ("bm25", "full")}, ("raw",)))
    assert [r["approach"] for r in rows] == ["bm25", "full"] and all(r["mrr_at_10"] == 1.0 for r in rows)
    config = load_config(overrides={"index.dir": str(tmp_path / "index/raw"), "representation": "raw"})
    engine = Engine(spark, "set", config)
    tuned = experiments.tuned_weights(engine, again, 3)
    assert abs(sum(tuned["ranking.weights"].values()) - 1) < 1e-6 and abs(sum(x for k, x in tuned.items() if k.endswith("_weight")) - 1) < 1e-6
    row = experiments.throughput(engine, again.queries, 1)[0]
    assert row["queries"] == 2 and all(row[f"{s}_s"] > 0 for s in experiments.STAGES)
    rows = list(experiments.latency(spark, again, str(tmp_path / "sizes"), (3, 9), 1))
    assert rows[0]["documents"] == 3 and rows[0]["total_p95_s"] > 0 and "skipped" in rows[1]


def test_datasets_of_any_path_and_form(spark, tmp_path):
    """Written by the tasks, to a path with a scheme; the map form of judgements is read too; a second writing replaces the first."""
    import json

    place = f"file://{tmp_path}/deep/set"
    write_dataset(dataset(spark), place)
    write_dataset(dataset(spark)._replace(corpus=dataset(spark).corpus.repartition(3)), place)
    again = read_dataset(spark, place)
    assert again.name == "set" and sorted(map(tuple, again.corpus.select("doc_id", "text").collect())) == DOCS
    assert sorted(map(tuple, again.qrels.collect())) == [("q1", "d2", 1), ("q2", "d4", 1)]
    assert {x.name for x in (tmp_path / "deep").iterdir()} == {"set"}
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "corpus.jsonl").write_text('{"id": "d1", "text": "one"}\n')
    (plain / "queries.jsonl").write_text('{"id": "q", "text": "one?"}\n')
    with pytest.raises(FileNotFoundError, match="qrels"):
        read_dataset(spark, str(plain))
    (plain / "qrels.json").write_text(json.dumps({"q": {"d1": 1, "d2": 0}}))
    assert sorted(map(tuple, read_dataset(spark, str(plain)).qrels.collect())) == [("q", "d1", 1), ("q", "d2", 0)]


def test_timings_of_one_run(spark, indexed):
    from lodeseek.plans.search import Timings

    repo, config, _ = indexed
    engine, timings = Engine(spark, "repo", config), Timings()
    found = engine.search(engine.queries(["open the vault", "pump water"]), top_k=3, timings=timings).collect()
    stages = {s["stage"]: s for s in timings.stages()}
    assert list(stages) == ["preprocess", "dense", "bm25", "identifier", "candidates", "results"]
    assert stages["results"]["rows"] == len(found) and stages["bm25"]["rows"] >= 2
    assert 0 < stages["preprocess"]["last_ms"] <= stages["bm25"]["first_ms"] <= stages["candidates"]["last_ms"] <= stages["results"]["last_ms"]
    few = engine.search(engine.queries("open the vault"), top_k=5, candidate_k=1).collect()
    assert 1 <= len(few) <= 1 and few[0].function == "open_vault"
    with pytest.raises(ValueError):
        engine.search(engine.queries("x"), candidate_k=0)


def test_an_inverted_file_serves_the_dense_channel(spark, tmp_path):
    from lodeseek.plans.index import index_dataset

    settings = {"index.dir": str(tmp_path / "index"), "representation": "raw", "embedding_model.lsa_dim": 3}
    config = load_config(overrides=settings | {"vector_index.ann": "ivf", "vector_index.flat_threshold": 2})
    index_dataset(spark, dataset(spark).corpus, "small", config)
    engine, exact = Engine(spark, "small", config), Engine(spark, "small", load_config(overrides=settings))
    assert engine.store.exists("cells/repository=small/version=v1")
    only = Options(use_bm25=False, use_identifier=False, use_query=False, use_rerank=False)
    for text in ("database connection", "red circle canvas"):
        assert [r.doc_id for r in top(engine, text, 1, options=only)] == [r.doc_id for r in top(exact, text, 1, options=only)]


def test_only_folders_of_the_terms_are_read(spark, tmp_path, monkeypatch, capsys):
    from lodeseek.operators import lexical
    from lodeseek.plans.index import index_dataset

    monkeypatch.setattr(lexical, "TOKENS_PER_BUCKET", 2)
    config = load_config(overrides={"index.dir": str(tmp_path / "index"), "representation": "raw"})
    index_dataset(spark, dataset(spark).corpus, "small", config)
    engine = Engine(spark, "small", config)
    tables = engine._tables("v1")
    about = tables["statistics"][0]
    assert about.buckets > 2 and about.n == len(DOCS)
    asked = spark.createDataFrame([(1, "databas", 1.0), (1, "connect", 1.0)], "query_id long, term string, weight double")
    found = lexical.score_stored(tables["postings"], tables["lexicon"], [about], asked, True)
    found.explain("formatted")
    plan = capsys.readouterr().out
    folders = {lexical.bucket_of(t, about.buckets) for t in ("databas", "connect")}
    assert len(folders) < about.buckets and all(f"bucket" in f and str(b) in f for b in folders for f in plan.split("PartitionFilters: ")[1:3])
    assert "PushedFilters: [In(term" in plan or "In(term, [connect,databas])" in plan
    large = lexical.score_stored(tables["postings"], tables["lexicon"], [about], asked, False)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, large.collect()))
    index_dataset(spark, dataset(spark).corpus.limit(1), "small", config)  # folders of the version that is replaced go
    again = engine._tables("v1")
    assert again["postings"].select("chunk_id").distinct().count() == 1 and again["lexicon"].count() == again["postings"].count()


def test_datasets_keep_the_metadata_of_code(spark, tmp_path):
    """Documents are indexed with what parsing finds, or with the chunk that was stored."""
    from lodeseek.plans.index import index_dataset

    code = "import zlib\n\ndef squeeze(data):\n    \"\"\"Makes data small.\"\"\"\n    return zlib.compress(data)\n"
    stored = spark.createDataFrame([("d2", "stored text", ("lib/x.py", "unpack_all", ["inflate"]))], "doc_id string, text string, chunk struct<file: string, function: string, calls: array<string>>")
    plain = spark.createDataFrame([("d1", code), ("d3", "no code at all (")], "doc_id string, text string")
    corpus = plain.withColumn("chunk", F.lit(None).cast(stored.schema["chunk"].dataType)).unionByName(stored)
    config = load_config(overrides={"index.dir": str(tmp_path / "index"), "embedding_model.lsa_dim": 4})
    assert index_dataset(spark, corpus, "mixed", config)["chunks"] == 3
    engine = Engine(spark, "mixed", config)
    found = {r.doc_id: r for r in engine._tables("v1")["chunks"].collect()}
    assert (found["d1"].function, found["d1"].doc, found["d1"].calls, found["d1"].imports) == ("squeeze", "Makes data small.", ["compress"], ["zlib"])
    assert (found["d2"].function, found["d2"].file, found["d2"].calls, found["d2"].code) == ("unpack_all", "lib/x.py", ["inflate"], "")
    assert found["d3"].function == "" and found["d3"].code == "no code at all ("
    assert top(engine, "unpack_all", 1)[0].method.startswith(("bm25+identifier", "identifier", "bm25+dense+identifier", "dense+identifier"))


def test_small_sources(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "conv_id long, turn long, text string")
    assert {tuple(r) for r in last_turns(turns).collect()} == {(1, "b"), (2, "c")}
    rows = spark.createDataFrame([(1, "T", "x"), (2, None, " y ")], "doc_id long, title string, text string")
    assert [r.text for r in titled(rows).orderBy("doc_id").collect()] == ["T\nx", "\n y".strip()]


def test_config(tmp_path):
    assert parse_override("a.b=1.5") == ("a.b", 1.5) and parse_override("a=x") == ("a", "x")
    (tmp_path / "c.json").write_text('{"retrieval": {"fusion": "rrf"}}')
    config = load_config(str(tmp_path / "c.json"), {"ranking.rerank_top_n": 7})
    assert (config["retrieval"]["fusion"], config["retrieval"]["bm25_top_k"], config["ranking"]["rerank_top_n"]) == ("rrf", 100, 7)
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


def test_command_line(spark, indexed, capsys):
    repo, config, _ = indexed
    cli.main(["--set", f"index.dir={config['index']['dir']}", "search", repo.name, "pressure on the water tank", "--top-k", "1"])
    assert "pump.py pump_water" in capsys.readouterr().out
