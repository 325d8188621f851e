"""The stored registry: delta checks equal all-against-all, and read their own folders only."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillstone.operators import fingerprint
from rillstone.operators.registry import DocumentRegistry, ProjectRegistry
from rillstone.plans import fixtures


def words(text):
    return re.findall("[a-z0-9']+", text.lower())


def sentences(text):
    return {" ".join(w) for w in (words(s) for s in re.split(r"(?<=[.!?])\s+", text.lower())) if len(w) >= 8}


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def opening(text):
    for p in re.split(r"\n\s*\n", text):
        p = re.sub(r"\s*\n\s*", " ", p.translate(str.maketrans("", "", "`*>_"))).strip()
        if p and not p.startswith("#") and len(p.split()) >= 5 and not p.endswith(":"):
            m = re.match(r"(.*?[.!?])\s", p, re.S)
            return (m[1] if m else p).lower()
    return ""


def plain(new, stored):
    out = {}
    for owner, text in new:
        text = text or ""
        others = [(o, x or "") for o, x in stored if o != owner]
        n = sum(bool(sentences(text) & sentences(x)) for _, x in others)
        best = min(((-len(g & h) / len(g | h), int(o)) for o, x in others for g, h in [(grams(text), grams(x))] if g and h and len(g & h) / len(g | h) >= 0.4), default=(0, None))
        same = sum(bool(opening(text)) and opening(text) == opening(x) for _, x in others)
        out[owner] = (n, None if best[1] is None else str(best[1]), None if best[1] is None else round(-best[0], 6), same, "FAIL" if n or same else "warn" if best[1] is not None else "ok")
    return out


STORY = "The keeper walked along the quay before the tide turned. Nobody had lit the lamp above the northern door that evening. Boats lay low."


def stored():
    rows = [(str(i), f"{STORY} Extra words number {i} follow here without an end") for i in range(1, 6)]
    return rows + [("6", "Quite another opening with five words. And a sentence that is shared by two of these texts here."), ("7", None), ("8", ""), ("9", "short"), ("10", STORY.replace("keeper", "warden"))]


def new():
    return [("100", STORY), ("101", "Nothing alike at all in this one. It has its own words and only those, from one end to the other."), ("102", "Another start that nobody has. and a sentence that is shared by two of these texts here."), ("103", None), ("104", ""), ("3", STORY)]


def result(df):
    return {r.owner: (r.n_verbatim, r.alike, r.jaccard, r.n_opening, r.severity) for r in df.collect()}


def test_texts_against_a_registry(spark, tmp_path):
    texts = lambda rows: spark.createDataFrame(rows, "owner string, text string")
    made = DocumentRegistry(spark, str(tmp_path), buckets=8)
    assert result(made.check(texts(new()))) == plain(new(), [])  # nothing registered yet
    assert made.register(texts(stored()[:4]), 0) and made.register(texts(stored()[4:]), 1) and not made.register(texts(stored()[4:]), 1)
    assert result(made.check(texts(new()))) == plain(new(), stored())
    changed = [("2", "Now it says something else that no other text has said before, in eight words or more.")]
    made.register(texts(changed), 2)
    now = [r for r in stored() if r[0] != "2"] + changed
    assert result(made.check(texts(new()))) == plain(new(), now)
    made.compact()
    assert len(made.elements.version().parts) == 1 and result(made.check(texts(new()))) == plain(new(), now)
    assert made.elements.read().where("owner = '2' AND kind = 'shingle'").select("batch").distinct().collect()[0].batch == 2
    assert made.check(texts([])).count() == 0


def test_only_folders_of_the_new_elements_are_read(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("owner"), "text")
    made = DocumentRegistry(spark, str(tmp_path))
    made.register(docs, 0)
    one = spark.createDataFrame([("new", "This sentence of nine words stands here quite alone.")], "owner string, text string")
    from rillstone.operators.registry import text_elements

    mine = made._dealt(text_elements(one).withColumn("size", F.lit(1)))
    held = made.elements.read()
    read, whole = made.reading(mine), held.inputFiles()
    files = {f for (f,) in read.select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 7 and len(whole) >= 100  # a sentence, an opening and five shingles
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "kind" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(fixtures.FILES, "root string, path string, text string")


def test_each_project_against_the_stored_rest(spark, files, tmp_path):
    whole = Counter(map(tuple, fingerprint.compare_projects(spark, files).collect()))
    roots = sorted(r.root for r in files.select("root").distinct().collect())
    for n, root in enumerate(roots[:2]):
        made = ProjectRegistry(spark, str(tmp_path / str(n)))
        made.register(files.where(F.col("root") != root), 0)
        got = Counter(map(tuple, made.check(files.where(F.col("root") == root)).collect()))
        assert got and got == Counter({r: c for r, c in whole.items() if r[0] == root.rsplit("/", 1)[1]})
    made.register(files.where(F.col("root") == roots[1]), 1)  # it is left out of its own check
    assert Counter(map(tuple, made.check(files.where(F.col("root") == roots[1])).collect())) == got
    assert {r.app for r in made.list().collect()} == {r.rsplit("/", 1)[1] for r in roots}


def test_two_roots_of_one_name_stay_apart(spark):
    decl = lambda *names: "".join(f"struct {n} {{\n}}\n" for n in names)
    some = [("/a/Demo", "Demo.xcodeproj/x", ""), ("/a/Demo", "Demo/a.swift", decl("Alpha", "DemoApp")), ("/b/Demo", "Demo.xcodeproj/x", ""), ("/b/Demo", "Demo/b.swift", decl("Beta", "Demo"))]
    df = spark.createDataFrame(some, "root string, path string, text string")
    got = {r.app: (r.root, r.types) for r in fingerprint.fingerprints_of(spark, df).collect()}
    assert got == {"Demo of /a/Demo": ("/a/Demo", "Alpha"), "Demo of /b/Demo": ("/b/Demo", "Beta")}
    from rillstone.operators import gates

    totals = {r.app: (r.n_fail, r.n_warn) for r in gates.project_totals(spark, df).collect()}
    alone = {r.app: (r.n_fail, r.n_warn) for r in gates.project_totals(spark, df.where("root = '/a/Demo'")).collect()}
    assert set(totals) == set(got) and totals["Demo of /a/Demo"] in (alone["Demo"], (alone["Demo"][0], alone["Demo"][1] - 1))  # no registry to speak of, alone
