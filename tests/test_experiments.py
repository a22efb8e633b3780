from lodeseek.plans.experiments import version_experiment
from lodeseek.sources.dataset import benchmark_of, functions_in_folders, without_docstring

NAMES = ["parse the header line of a table", "open the database connection for a user", "draw a red circle on the canvas", "sort numbers in a long list", "send the mail to all members", "count words of the given text"]


def write(folder):
    for i, about in enumerate(NAMES):
        name = about.replace(" ", "_")
        (folder / f"m{i}.py").write_text(f'def {name}(value):\n    """{about.capitalize()}. More.\n\n    Second."""\n    result = {about.split()[1]}(value)\n    return result\n')


def test_documentation_is_cut_out():
    assert without_docstring('    def f(x):\n        """A.\n        B."""\n        return x') == "    def f(x):\n        return x"
    assert without_docstring("def f(:") == "def f(:" and without_docstring("x = 1") == "x = 1"


def test_benchmark_and_versions(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    write(code)
    units = functions_in_folders(spark, [str(code)], 100).cache()
    assert units.count() == len(NAMES)
    made = benchmark_of(units, 10)
    asked = {r.text: r.query_id for r in made.queries.collect()}
    assert set(asked) == {n.capitalize() + '.' for n in NAMES}
    assert all("Second" not in r.text for r in made.corpus.collect()) and made.qrels.count() == len(NAMES)
    queries = made.queries.join(made.qrels, "query_id").select("query_id", "text", "doc_id")
    got = version_experiment(spark, units, queries, str(tmp_path / "index"), share=0.5)
    assert got["computed_on_v2"] + got["cached_on_v2"] == len(NAMES) and got["mrr_all"] > 0.9
    assert got["duplicate_rate_collapsed"] <= got["duplicate_rate_all"] and got["duplicate_rate_all"] > 0


def test_halves_are_equal(spark):
    from lodeseek.plans.experiments import split_queries

    first, second = split_queries(spark.range(101).selectExpr("concat('q', id) as query_id", "'x' as text"))
    assert (first.count(), second.count()) == (51, 50) and first.join(second, "query_id").isEmpty()


def test_renamed_units(spark):
    from pyspark.sql import functions as F

    from lodeseek.operators.versions import refactored

    rows = spark.createDataFrame([("f", "def f(f): pass\ndef f(x): pass", "def f(f)"), ("a.b", "def aXb(): pass\ndef a.b(): pass", "a.b"), ("", "x", "x")], "function string, code string, signature string")
    got = {r.code: (r.function, r.signature) for r in refactored(rows, F.lit(True)).collect()}
    assert got == {
        "def refactored_f(f): pass\ndef f(x): pass\n# refactored": ("refactored_f", "derefactored_f f(f)"),
        "def aXb(): pass\ndef refactored_a.b(): pass\n# refactored": ("refactored_a.b", "refactored_a.b"),
        "x": ("", "x"),
    }
