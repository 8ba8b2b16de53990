"""Release checks on the question table and its texts."""

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from ..session import cut_lineage
from .generate import per_template
from .programs import run_programs
from .splits import head_per_group

# --- fixed values -------------------------------------------------------------
REQUIRED = [
    "qid", "uniprot", "species", "family", "template", "question",
    "program", "answer", "answer_type", "params", "paraphrase_id",
]
HN1_MINIMUM = 0.50
LEXICAL_LIMIT = 0.55
# At least one of a family's words must appear in a question's text.
FAMILY_WORDS = {
    "A": [
        "plddt", "confidence", "confident", "reliab", "modelled", "modeled", "well-modelled", "well modelled",
        "well modeled", "score", "predicted accuracy", "alphafold", "poorly predicted", "weakest", "weakly", "weak",
        "strong", "strongest", "weak point", "uncertain", "uncertainty", "worst-predicted", "best-predicted",
        "worst predicted", "best predicted", "highest-quality", "lowest-quality", "highest quality",
        "lowest quality", "best-modelled", "worst-modelled",
    ],
    "B": [
        "distance", "apart", "separated", "separates", "separation", "far", "close", "angstrom", "Å", "ca-ca",
        "ca–ca", "ca to ca", "ca - ca", "alpha-carbon", "alpha carbon", "within 12", "within 8", "within 10",
        " within ", "contact", "contacts", "span", "spans in", "spatial separation",
    ],
    "C": [
        "pae", "predicted aligned error", "alignment error", "aligned error", "error", "uncertainty",
        "relative-position uncertainty", "position uncertainty",
    ],
    "D": [
        "sasa", "solvent", "accessib", "buried", "expose", "surface", "neighbor", "neighbour", "neighbors",
        "neighbours", "coordinat", "ligation", "within 8", "within 8 angstroms", "8 a", "8 å", "packed", "packing",
        "pack ", "contact count", "contact number", "sphere", "ca-ca contacts", "ca–ca contacts", "number of ca-ca",
        "8-angstrom cutoff", "8 angstrom cutoff",
    ],
    "E": [
        "helix", "helices", "helical", "alpha-helix", "alpha helix", "sheet", "strand", "loop", "coil",
        "secondary structure", "secondary-structure", "ss", "h/e/c", "dssp", "h-residue", "h residue", "h-run",
        "h run", "h-runs", "runs of", "h-segment", "h segment", "contiguous h", "stretch of h",
    ],
    "F": [
        "contact", "compact", "neighbour", "neighbor", "topology", "density", "stretch", "fold", "rg",
        "radius of gyration", "radius", "gyration", "extended", "extension", "spatial spread", "spread", "fraction",
        "proportion", "pair within", "pairs within", "pairs in",
    ],
}
# ------------------------------------------------------------------------------


def missing_fields(rows: DataFrame) -> DataFrame:
    """Per split: rows in which a required field is absent, and which."""
    absent = [F.when(F.col(c).isNull() if c in rows.columns else F.lit(True), F.lit(c)) for c in REQUIRED]
    return rows.withColumn("missing", F.array_compact(F.array(*absent))).where(F.size("missing") > 0)


def gate_table(split_rows: DataFrame, species: str = "human") -> DataFrame:
    """gate, passed, n_issues: schema, disjointness of the three parts of the
    main species, purity of the cross-species split, hard-negative mix."""
    bad = missing_fields(split_rows).agg(F.lit("schema").alias("gate"), F.count(F.lit(1)).alias("n_issues"))
    parts = F.col("split").isin("train", "dev", "test_iid") & (F.col("species") == species)
    shared = (
        split_rows.where(parts).groupBy(*KEY).agg(F.count_distinct("split").alias("_n")).where("_n > 1")
        .agg(F.lit("protein_disjointness").alias("gate"), F.count(F.lit(1)).alias("n_issues"))
    )
    impure = split_rows.where((F.col("split") == "test_cross_species") & (F.col("species") == species)).agg(
        F.lit("cross_species_pure").alias("gate"), F.count(F.lit(1)).alias("n_issues")
    )
    hn = split_rows.where("split = 'test_hn'").agg(
        F.lit("hn_class_distribution").alias("gate"),
        F.when(
            F.coalesce(F.try_divide(F.count_if(F.col("hn_class") == "HN1"), F.count(F.lit(1))), F.lit(0.0)) < HN1_MINIMUM, 1
        ).otherwise(0).cast("long").alias("n_issues"),
    )
    out = bad.unionByName(shared).unionByName(impure).unionByName(hn)
    return out.withColumn("passed", F.col("n_issues") == 0)


def programs_execute(split_rows: DataFrame, chains, per_split: int = 200, seed=7) -> DataFrame:
    """Programs of a fixed number of questions per split that fail to run.
    Hard negatives and abstaining families are exempt."""
    eligible = split_rows.where((F.col("split") != "test_hn") & ~F.col("family").isin("Ha", "Hb"))
    picked = head_per_group(eligible, ["split"], per_split, seed=seed)
    ran = run_programs(picked.select("qid", *KEY, "program"), chains)
    return ran.where("err is not null").select("qid", "err")


def lexical_terms(text: str = "question") -> PipelineModel:
    """Unigrams and bigrams, counted in hash buckets; nothing is learned."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\w\w+", gaps=False)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
    # Every term counts: terms share hash buckets, and no vocabulary is gathered.
    return PipelineModel([words, pairs, both, HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=1 << 18)])


def lexical_classifier(label: str = "label") -> Pipeline:
    """Counts, weighted by rarity, into a logistic regression."""
    idf = IDF(inputCol="_counts", outputCol="_weighted", minDocFreq=2)
    unit = Normalizer(inputCol="_weighted", outputCol="features", p=2.0)
    return Pipeline(stages=[idf, unit, LogisticRegression(labelCol=label, maxIter=50)])


def lexical_gate(train: DataFrame, test: DataFrame, text="question", label="label") -> DataFrame:
    """How well the words alone predict the answer on held-out rows."""
    terms = lexical_terms(text)
    # The fit reads its rows three times; texts are taken apart once.
    counted = cut_lineage(terms.transform(train).select(label, "_counts"))
    scored = lexical_classifier(label).fit(counted).transform(terms.transform(test))
    return scored.agg(
        F.count(F.lit(1)).alias("n_test"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")
    ).withColumn("passed", F.col("accuracy") <= LEXICAL_LIMIT)


def missing_numbers(question: Column, params: Column) -> Column:
    """Integer parts of the parameters (of magnitude one or more) that the
    question text does not mention."""
    stated = F.transform(F.regexp_extract_all(question, F.lit(r"(\d+)"), F.lit(1)), lambda v: v.try_cast("long"))
    needed = F.filter(
        F.transform(
            # which terminus comes first is a word, not a number
            F.map_values(F.map_filter(params, lambda k, v: k != "n_first")), lambda v: v.cast("long")
        ), lambda v: F.abs(v) >= 1
    )
    return F.array_sort(F.array_except(needed, stated))


def mentions_family(question: Column, family: Column) -> Column:
    low = F.lower(question)
    out = None
    for name, words in FAMILY_WORDS.items():
        hit = low.rlike("|".join(words))
        if name == "E":
            hit = hit | question.rlike(r"\bSS\b")
        out = (F.when if out is None else out.when)(family == name, hit)
    return out.otherwise(True)


def surface_check(questions: DataFrame) -> DataFrame:
    """Adds missing_params, ok_numbers and ok_keyword."""
    return questions.withColumn(
        "missing_params", missing_numbers(F.col("question"), F.col("params"))
    ).withColumns({
        "ok_numbers": F.size("missing_params") == 0,
        "ok_keyword": mentions_family(F.col("question"), F.col("family")),
    })


def most_missing(checked: DataFrame) -> DataFrame:
    """Failing texts per template, the most frequent first."""
    return checked.where("not ok_numbers or not ok_keyword").groupBy("template").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("n"), "template")


def leaks_program(question: Column) -> Column:
    """Does a wording contain an operator call of its own program?"""
    calls = per_template(
        lambda t: "|".join(rf"\b{n}\(" for n in sorted(set(re.findall(r"([a-z_]+)\(", t.program)))) or r"$.^"
    )
    return F.rlike(F.lower(question), calls)


def wording_statistics(pool: DataFrame) -> DataFrame:
    """Wordings and distinct wordings per template."""
    return pool.groupBy("template").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("wording").alias("n_distinct")
    )
