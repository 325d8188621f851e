"""A stored registry of fingerprints, and the check of new ones against it.

The registry is inverted: ``elements(kind, element, owner, size)`` says which owner holds which
type, file, keyword, sentence, shingle, opening or prefix, and how many of that kind it holds.
It grows by versions (``VersionedTable``), each dealt out by kind and hash of the element, so a
check reads the folders of its own elements only and joins them by equality; it never compares
owners with owners.  Registering an owner again supersedes what it held: elements carry the
number of their batch, and ``owners`` has the newest one.

``DocumentRegistry`` grades texts (verbatim sentences, resemblance, equal openings),
``ProjectRegistry`` grades project fingerprints by the rules of ``fingerprint.compare``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import row_grams, row_sentences, shared_counts
from ..plans.registry import ask, plan, table
from ..plans.tables import shared_dir, written
from ..sources.versioned import VersionedTable
from .fingerprint import THEIRS, compared, prints, said
from .similarity import first_sentence

BUCKETS, LIKE, SLICES = 64, 0.4, 8
FEW = 400_000  # given elements that are broadcast at once
_ELEMENTS = "element string, owner string, size long, batch long, kind string, bucket int"


class Registry:
    """``elements`` and ``owners`` in a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.elements = VersionedTable(spark, f"{path}/elements", _ELEMENTS, distinct=["element"])
        self.owners = VersionedTable(spark, f"{path}/owners", "owner string, batch long")

    def _dealt(self, elements: DataFrame) -> DataFrame:
        number = F.coalesce(F.col("element").try_cast("long"), F.xxhash64("element"))  # hashes as they are
        return elements.withColumn("bucket", F.pmod(number, F.lit(self.buckets)).cast("int"))

    def add(self, elements: DataFrame, owners: DataFrame, batch: int) -> bool:
        """Register ``owners(owner)`` with ``elements(kind, element, owner)`` as one batch.

        Elements come first: until the owners' version is there, they belong to no one, and a
        batch that is handed in again after a crash between the two changes nothing."""
        made = "size" in elements.columns
        sizes = Window.partitionBy("kind", "owner")
        own = elements if made else elements.select("kind", "element", "owner").distinct().withColumn("size", F.count("*").over(sizes))
        rows = self._dealt(own.withColumn("batch", F.lit(batch).cast("long"))).select("element", "owner", "size", "batch", "kind", "bucket")
        dealt = lambda some: some.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "element")
        if made:
            # Shingles of texts are most of all rows: each task writes its own of them, without a shuffle.
            mass = F.col("kind") == "shingle"
            slices = [dealt(rows.where(~mass)), rows.where(mass)]
        else:
            slices = [dealt(rows.where(F.col("bucket") % SLICES == i)) for i in range(SLICES)]
        self.elements.commit(slices, "registry", batch, by=["kind", "bucket"])
        return self.owners.commit(owners.select("owner").distinct().withColumn("batch", F.lit(batch).cast("long")), "registry", batch)

    def current(self) -> DataFrame:
        """Owners with the batch that counts."""
        return self.owners.read().groupBy("owner").agg(F.max("batch").alias("batch"))

    def matching(self, elements: DataFrame) -> DataFrame:
        """``(kind, element, owner, size, other, other_size)``: registered elements equal to the given
        ones.  Only folders of ``(kind, bucket)`` that the given elements fall into are read."""
        return self.met(self.sized(elements)).select("kind", "element", "owner", "size", "other", "other_size")

    def sized(self, elements: DataFrame) -> DataFrame:
        """``elements`` with the size of each kind of an owner, and their buckets, written."""
        sizes = Window.partitionBy("kind", "owner")
        return written(self._dealt(elements.select("kind", "element", "owner").distinct().withColumn("size", F.count("*").over(sizes))))

    def met(self, mine: DataFrame) -> DataFrame:
        """``matching`` of sized elements.  The stored ones stay where they are: those of some folders
        meet a broadcast of the given ones that fall into them."""
        count = mine.count()
        slices = max(1, min(self.buckets, -(-count // FEW)))
        alive = self.alive()
        out = []
        for i in range(slices):
            own = mine.where(F.col("bucket") % slices == i)
            stored = alive(self.reading(own)).select("kind", "element", F.col("owner").alias("other"), F.col("size").alias("other_size"))
            out.append(stored.join(F.broadcast(own.drop("bucket")) if count <= FEW * self.buckets else own.drop("bucket"), ["kind", "element"]))
        met = out[0]
        for part in out[1:]:
            met = met.unionByName(part)
        return met

    def alive(self):
        """A filter of stored elements: those of batches whose owners are there, and of no owner that
        came again later.  Superseded owners are looked up, as they are few beside the others."""
        owners = self.owners.read()
        batches = [r["batch"] for r in owners.select("batch").distinct().collect()]  # one for each version at most
        newest = self.current().select("owner", F.col("batch").alias("newest"))
        old = written(owners.join(newest, "owner").where("batch < newest").select("owner", "batch").distinct())
        n_old = old.count()
        old = F.broadcast(old) if n_old <= FEW else old
        kept = lambda rows: rows.where(F.col("owner").isNotNull() & F.col("batch").isin(batches))
        return (lambda rows: kept(rows).join(old, ["owner", "batch"], "left_anti")) if n_old else kept

    def reading(self, mine: DataFrame) -> DataFrame:
        """The part of ``elements`` that can meet ``mine(kind, bucket)``."""
        wanted = mine.select("kind", "bucket").distinct().collect()  # at most kinds x buckets
        stored = self.elements.read()
        if not wanted:
            return stored.limit(0)
        by: dict[str, list[int]] = {}
        for r in wanted:
            by.setdefault(r["kind"], []).append(r["bucket"])
        fits = F.lit(False)
        for kind, buckets in sorted(by.items()):
            fits |= (F.col("kind") == kind) & F.col("bucket").isin(sorted(buckets))
        return stored.where(fits)

    def compact(self) -> None:
        """Fold versions into one; elements of superseded batches go."""
        current = written(self.current())
        live = lambda rows: rows.join(current, ["owner", "batch"], "left_semi").select(*[c.split()[0] for c in _ELEMENTS.split(", ")])
        self.elements.compact(lambda rows: live(rows).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "element"), by=["kind", "bucket"])
        self.owners.compact(lambda rows: rows.groupBy("owner").agg(F.max("batch").alias("batch")))


def text_elements(texts: DataFrame) -> DataFrame:
    """``(kind, element, owner)`` of ``texts(owner, text)``: sentences of eight words, five-word
    shingles (as 64-bit hashes) and the opening."""
    texts = texts.select(F.col("owner").cast("string").alias("id"), "text")
    said = row_sentences(texts, sized=True)
    sentences = said.select(F.lit("sentence").alias("kind"), F.col("s").alias("element"), F.col("id").alias("owner"))
    grams = row_grams(texts, BUCKETS)
    shingles = grams.select(F.lit("shingle").alias("kind"), F.col("h").cast("string").alias("element"), F.col("id").alias("owner"))
    opening = ask(texts.sparkSession, lambda d: f"SELECT 'opening' AS kind, element, owner FROM (SELECT id AS owner, {first_sentence(d, 'text')} AS element FROM texts) x WHERE element <> ''", texts=texts)
    if not texts.groupBy("id").count().where("count > 1").take(1):  # sizes are those of single rows
        sentences = said.select(F.lit("sentence").alias("kind"), F.col("s").alias("element"), F.col("id").alias("owner"), F.col("n").alias("size"))
        shingles = grams.select(F.lit("shingle").alias("kind"), F.col("h").cast("string").alias("element"), F.col("id").alias("owner"), F.col("n").alias("size"))
        return sentences.unionByName(shingles).unionByName(opening.withColumn("size", F.lit(1).cast("long")))
    return sentences.unionByName(shingles).unionByName(opening).distinct()


class DocumentRegistry(Registry):
    """Texts against registered texts."""

    def register(self, texts: DataFrame, batch: int) -> bool:
        """Of ``texts(owner, text)``."""
        return self.add(text_elements(texts), texts.select(F.col("owner").cast("string").alias("owner")), batch)

    def nearest(self, grams: DataFrame, like: float) -> DataFrame:
        """``(owner, b(other, j))``: the registered set most like that of each owner of sized shingles.

        The stored shingles that are asked for are read once.  A set like a given one has ``like`` of
        its own among them; the others go, and sets with the same of them and of one size are one
        class, as are given sets.  Two like sets of n shingles, s of which both sides know, have one in
        common among the first s - ``like`` * n + 1, rarest first: those join, then the sets decide."""
        enough = F.ceil(F.col("n") * F.lit(like) - 1e-9)
        wanted = written(grams.select("kind", "element", "bucket").distinct())
        held = self.met(wanted).select("other", F.col("other_size").alias("n"), F.col("element").cast("long").alias("h"))
        theirs = held.groupBy("other", "n").agg(F.array_sort(F.collect_list("h")).alias("set")).where(F.size("set") >= enough)
        order = Window.partitionBy("set", "n").orderBy(F.col("other").try_cast("long"), "other")
        # Of a class the first two members are enough: one of them isn't the owner itself.
        theirs = written(theirs.withColumn("place", F.row_number().over(order)).where("place <= 2"))
        pair = F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"])
        sets = written(theirs.groupBy("set", "n").agg(pair.alias("others")).withColumn("b", F.monotonically_increasing_id()))
        counts = written(sets.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("d")))
        ours = grams.select("owner", F.col("size").alias("n"), F.col("element").cast("long").alias("h")).join(counts, "h")
        ours = ours.groupBy("owner", "n").agg(F.array_sort(F.collect_list("h")).alias("set")).where(F.size("set") >= enough)
        ours = written(ours.groupBy("set", "n").agg(F.collect_list("owner").alias("owners")).withColumn("a", F.monotonically_increasing_id()))

        def firsts(rows, c):
            """The rarest shingles of each class."""
            all_ = rows.select(c, "n", F.explode("set").alias("h")).join(counts, "h")
            ranked = all_.groupBy(c, "n").agg(F.array_sort(F.collect_list(F.struct("d", "h"))).alias("all"))
            first = F.slice("all", F.lit(1), (F.size("all") - enough + 1).cast("int"))
            return ranked.select(F.col(c), F.col("n").alias(f"n{c}"), F.explode(first).alias("x")).select(c, f"n{c}", F.col("x.h").alias("h"))

        fits = F.least("na", "nb") >= like * F.greatest("na", "nb")
        likely = written(firsts(ours, "a").join(firsts(sets, "b"), "h").where(fits).select("a", "b", "na", "nb").distinct())
        met = likely.join(ours.select("a", F.col("set").alias("x")), "a").join(sets.select("b", F.col("set").alias("y")), "b")
        jaccard = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
        pairs = shared_counts(met, "x", "y").withColumn("j", jaccard).where(F.col("j") >= like)
        each = pairs.join(ours.select("a", F.explode("owners").alias("owner")), "a").join(sets.select("b", "others"), "b")
        other = F.filter("others", lambda o: o != F.col("owner"))
        each = each.select("owner", "j", F.get(other, F.lit(0)).alias("other")).where("other IS NOT NULL")
        return each.groupBy("owner").agg(F.min_by(F.struct("other", "j"), F.struct(-F.col("j"), F.col("other").try_cast("long"), "other")).alias("b"))

    def check(self, texts: DataFrame, like: float = LIKE) -> DataFrame:
        """A row for each of ``texts(owner, text)``: how many registered texts share a sentence, the
        most similar one (shingle Jaccard ``like`` or more; ties to the smaller owner) and how
        many have the same opening; an owner's own earlier text doesn't count."""
        mine = self.sized(text_elements(texts))
        met = lambda kind: self.met(mine.where(F.col("kind") == kind)).where("owner <> other")
        shared = met("sentence").groupBy("owner").agg(F.count_distinct("other").alias("n_verbatim"))
        opened = met("opening").groupBy("owner").agg(F.count("*").alias("n_opening"))
        best = self.nearest(mine.where("kind = 'shingle'"), like)
        out = texts.select(F.col("owner").cast("string").alias("owner")).distinct().join(shared, "owner", "left").join(best, "owner", "left").join(opened, "owner", "left")
        n_verbatim, n_opening = F.coalesce("n_verbatim", F.lit(0)), F.coalesce("n_opening", F.lit(0))
        severity = F.when((n_verbatim > 0) | (n_opening > 0), "FAIL").when(F.col("b").isNotNull(), "warn").otherwise("ok")
        return out.select("owner", n_verbatim.alias("n_verbatim"), F.col("b.other").alias("alike"), F.round("b.j", 6).alias("jaccard"), n_opening.alias("n_opening"), severity.alias("severity"))


class ProjectRegistry(Registry):
    """Project fingerprints against registered ones."""

    def _mine(self, files: DataFrame) -> dict[str, DataFrame]:
        """Written tables of the projects in ``files(root, path, text)``."""
        made = {"prints": "*", "types": "app, t", "names": "app, f", "keywords": "app, k"}
        return {name: written(ask(self.spark, lambda d, n=name, c=columns: f"WITH {prints(d)} SELECT {c} FROM {n}", files=files)) for name, columns in made.items()}

    def _elements(self, mine: dict[str, DataFrame]) -> DataFrame:
        """What the comparison joins on, from its own tables."""
        kinds = {"type": ("own", "t"), "file": ("names", "f"), "keyword": ("keywords", "k"), "sentence": ("sents", "s"), "shingle": ("sh", "s"), "prefix": ("pre", "p")}
        sql = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {c} AS element, app AS owner FROM {name}" + (" WHERE dots >= 2" if kind == "prefix" else "") for kind, (name, c) in kinds.items())
        sql += " UNION ALL SELECT 'opening', first_sentence, app FROM prints WHERE first_sentence <> ''"
        return written(ask(self.spark, lambda d: f"WITH {compared(d)} {sql}", **mine))

    def register(self, files: DataFrame, batch: int) -> bool:
        mine = self._mine(files)
        return self.add(self._elements(mine), mine["prints"].select(F.col("app").alias("owner")), batch)

    def check(self, files: DataFrame) -> DataFrame:
        """``(app, rule, severity, detail)`` of every project in ``files`` against the registry;
        registered apps of its own name are left out."""
        mine = self._mine(files)
        met = written(self.matching(self._elements(mine)))
        held = lambda kind, c: met.where(F.col("kind") == kind).select(F.col("other").alias("app"), F.col("element").alias(c)).distinct()
        everyone = self.current().select(F.col("owner").alias("app"))
        theirs = {
            "own": held("type", "t"), "names": held("file", "f"), "keywords": held("keyword", "k"), "sents": held("sentence", "s"),
            "sh": met.where("kind = 'shingle'").select(F.col("other").alias("app"), F.col("element").alias("s"), F.col("other_size").alias("n")).distinct(),
            "prints": everyone.join(held("opening", "first_sentence"), "app", "left"), "pre": held("prefix", "p").withColumn("dots", F.lit(2)),
        }
        return ask(self.spark, lambda d: f"WITH {compared(d, THEIRS)} SELECT {said('app')} AS app, rule, severity, {said('detail')} AS detail FROM graded", **mine, **{THEIRS[k]: v for k, v in theirs.items()})

    def list(self) -> DataFrame:
        """``(app, n_types, bundle_prefix)`` of what is registered, from its elements."""
        now = self.elements.read().join(self.current(), ["owner", "batch"])
        counts = now.where("kind = 'type'").groupBy("owner").agg(F.count("*").alias("n_types"))
        prefix = now.where("kind = 'prefix'").groupBy("owner").agg(F.min("element").alias("bundle_prefix"))
        return self.current().join(counts, "owner", "left").join(prefix, "owner", "left").select(F.expr(said("owner")).alias("app"), F.coalesce("n_types", F.lit(0)).alias("n_types"), "bundle_prefix")


_SENTENCE = "regexp_extract_all(s, '[a-z0-9\\x27]+')"
_CHECKED = f"""WITH raw AS (SELECT doc_id, doc_id % 100 = 0 AS mine, text FROM documents),
parts AS (SELECT doc_id, mine, unnest(string_split(regexp_replace(lower(text), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM raw),
said AS (SELECT DISTINCT doc_id, mine, array_to_string(w, ' ') AS s FROM (SELECT doc_id, mine, {_SENTENCE} AS w FROM parts) x WHERE len(w) >= 8),
verbatim AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n FROM said a JOIN said b ON a.s = b.s WHERE a.mine AND NOT b.mine GROUP BY a.doc_id),
words AS (SELECT doc_id, mine, regexp_extract_all(lower(text), '[a-z0-9\\x27]+') AS w FROM raw),
grams AS (SELECT DISTINCT doc_id, mine, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, mine, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words) x),
many AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g WHERE a.mine AND NOT b.mine GROUP BY a.doc_id, b.doc_id),
close AS (SELECT m.doc_id, m.other, CAST(m.c AS DOUBLE) / (x.n + y.n - m.c) AS j FROM met m JOIN many x ON x.doc_id = m.doc_id JOIN many y ON y.doc_id = m.other),
best AS (SELECT doc_id, other, j FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, other) AS place FROM close WHERE j >= 0.4) x WHERE place = 1),
plain AS (SELECT doc_id, mine, trim(regexp_replace(translate(unnest(regexp_split_to_array(text, '\\n\\s*\\n')), '`*>_', ''), '\\s*\\n\\s*', ' ', 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS p, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) AS place FROM raw),
opens AS (SELECT doc_id, mine, arg_min(p, place) AS p FROM plain WHERE p <> '' AND p NOT LIKE '#%' AND len(regexp_split_to_array(p, '\\s+')) >= 5 AND NOT regexp_matches(p, '[А-Яа-яЁё]') AND p NOT LIKE '%:' GROUP BY doc_id, mine),
firsts AS (SELECT doc_id, mine, lower(CASE WHEN regexp_matches(p, '[.!?]\\s') THEN regexp_extract(p, '^(.*?[.!?])\\s', 1) ELSE p END) AS f FROM opens),
same AS (SELECT a.doc_id, count(*) AS n FROM firsts a JOIN firsts b ON a.f = b.f WHERE a.mine AND NOT b.mine AND a.f <> '' GROUP BY a.doc_id)
SELECT r.doc_id, coalesce(v.n, 0) AS n_verbatim, b.other AS alike, round(b.j, 6) AS jaccard, coalesce(s.n, 0) AS n_opening, CASE WHEN v.n > 0 OR s.n > 0 THEN 'FAIL' WHEN b.j IS NOT NULL THEN 'warn' ELSE 'ok' END AS severity
FROM raw r LEFT JOIN verbatim v ON v.doc_id = r.doc_id LEFT JOIN best b ON b.doc_id = r.doc_id LEFT JOIN same s ON s.doc_id = r.doc_id WHERE r.mine"""


@plan(_CHECKED)
def registry_check(spark, sf_dir):
    """Every hundredth document, as it comes in, against the registry of all others."""
    import uuid

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), "text")
    stored = DocumentRegistry(spark, f"{shared_dir(spark)}/r-{uuid.uuid4().hex}")
    stored.register(docs.where("owner % 100 <> 0"), 0)
    return stored.check(docs.where("owner % 100 = 0")).withColumn("alike", F.col("alike").cast("long")).select(F.col("owner").cast("long").alias("doc_id"), "n_verbatim", "alike", "jaccard", "n_opening", "severity")
