"""Relations of formulas derived from the driver's tables, which hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.functions.analysis import with_features
from axiomata.operators.scratch import fresh_dir
from axiomata.operators.store import Store

#: p_type -> operator of the derived formula.
HEADS = {"SMALL": "Sin", "MEDIUM": "BesselJ", "LARGE": "Log", "ECONOMY": "Gamma", "PROMO": "Zeta", "STANDARD": "Erf"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula per part, in canonical text, with the columns of a stored formula but tokens and facets."""
    power = F.concat((F.col("p_size") % 5 - 2).cast("string"), F.when(F.col("p_size") % 3 == 0, F.lit("/2")).otherwise(F.lit("")))
    head = F.coalesce(*[F.when(F.col("p_type") == t, F.lit(h)) for t, h in HEADS.items()])
    form = F.concat(F.lit("Plus[Power[v0,#"), power, F.lit("],"), head, F.lit("[v1]]"))
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entry_id"), F.lit("rhs").alias("side"), F.col("p_name").alias("label"), F.col("p_brand").alias("source"),
        F.col("p_type").alias("class"), F.lit("").alias("latex"), form.alias("mma"), form.alias("canonical"), F.lit("").alias("verified"),
    )
    return rows.withColumn("signature", F.sha2("canonical", 256))


def part_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tokens and facets."""
    return with_features(part_formulas(spark, sf_dir)).withColumn("side_latex", F.lit(""))


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a left side, the part's name, which every fourth part lacks, and the formula as the right."""
    lhs = F.when(F.substring("entry_id", -1, 1).isin("0", "5"), F.lit(" ")).otherwise(F.col("label"))
    return part_formulas(spark, sf_dir).select(F.col("entry_id").alias("id"), "label", "source", "class", "latex", lhs.alias("lhs"), F.col("mma").alias("rhs"), "verified")


#: Mathematica text of derived sides; ``{n}`` is a number of the part. One can't be parsed, one is blank.
FORMS = (
    "x^{n} + y", "{n}*a*b - c", "Sin[{n}*t]/t", "Sqrt[u + {n}]", "Integrate[Exp[-{n}*s], {s, 0, Infinity}]", "Sum[k^(-{n}), {k, 1, Infinity}]",
    "BesselJ[{n}, z]", "Binomial[m, {n}]", "Log[{n}, w] <= Pi", "(g/h)^{n}", "Gamma[r]*{n}!", "Abs[-q] -> {n}", "p[{n}", "  ", "Product[1 - p/{n}, p]",
    "Floor[x]^(-{n})", "alpha*{n}*3", "Sech[{n} y] == MyFun[y, \"s\"]", "Hypergeometric2F1[a, b, c, {n}]",
)


def source_entries(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """Entries in Mathematica notation, one per part. ``changed``: every tenth of them with another right side."""
    n = (F.col("p_size") % 7 + 2).cast("string")
    forms = F.array(*[F.lit(t) for t in FORMS])
    text = lambda k: F.replace(F.get(forms, (k % len(FORMS)).cast("int")), F.lit("{n}"), n)
    rows = table(spark, sf_dir, "part")
    if changed:
        rows = rows.where("p_partkey % 10 = 0")
    key = F.col("p_partkey")
    return rows.select(
        F.concat(F.lit("part-"), key.cast("string")).alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("source"), F.col("p_type").alias("class"),
        F.concat(F.lit("$"), "p_name", F.lit("$,")).alias("latex"), text(key).alias("lhs"), (F.replace(F.lit(FORMS[0]), F.lit("{n}"), n) if changed else text(key * 5 + 3)).alias("rhs"), F.lit("").alias("verified"),
    )


def write_corpus(entries: DataFrame, folder: str, files: int) -> list[str]:
    """Entries as so many corpus files, each a JSON array; returns their folders."""
    keyed = entries.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(files)))
    arrays = keyed.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*entries.columns)))).alias("text"))
    arrays.repartition(files, "file").write.partitionBy("file").text(folder)
    return [f"{folder}/file={k}/*" for k in range(files)]


_stores: dict[tuple[str, str], Store] = {}


def part_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store that took in all derived entries, then those that changed; made once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stores:
        root = fresh_dir(spark, "store")
        store = Store(spark, f"{root}/tables")
        store.reset()
        for k, (changed, files) in enumerate(((False, 8), (True, 1))):
            store.ingest(write_corpus(source_entries(spark, sf_dir, changed), f"{root}/corpus-{k}", files))
        _stores[at] = store
    return _stores[at]


#: What those forms are in canonical text, LaTeX, facets and operators, spelled out by hand; ``{3n}`` is three times the number.
FORMS_SQL = r"""
forms(k, mma, canonical, latex, facets, ops) AS (VALUES
  (0, 'x^{n} + y', 'Plus[Power[v0,#{n}],v1]', 'x^{{n}} + y', '', 'Plus Power'),
  (1, '{n}*a*b - c', 'Plus[Times[#-1,v0],Times[#{n},v1,v2]]', '{n} a b - c', '', 'Plus Times Times'),
  (2, 'Sin[{n}*t]/t', 'Times[Power[v0,#-1],Sin[Times[#{n},v0]]]', '\frac{\sin\!\left({n} t\right)}{t}', 'fraction trigonometric', 'Times Power Sin Times'),
  (3, 'Sqrt[u + {n}]', 'Power[Plus[#{n},v0],#1/2]', '\sqrt{u + {n}}', 'square-root', 'Power Plus'),
  (4, 'Integrate[Exp[-{n}*s], {s, 0, Infinity}]', 'Integrate[#0,$Infinity,Power[$E,Times[#-{n},@0]]]', '\int_{0}^{\infty} e^{-{n} s}\,ds', 'definite-integral has-e infinite-limit integral', 'Integrate Power Times'),
  (5, 'Sum[k^(-{n}), {k, 1, Infinity}]', 'Sum[#1,$Infinity,Power[@0,#-{n}]]', '\sum_{k=1}^{\infty} k^{-{n}}', 'fraction infinite-limit sum', 'Sum Power'),
  (6, 'BesselJ[{n}, z]', 'BesselJ[#{n},v0]', 'J_{{n}}\!\left(z\right)', 'bessel', 'BesselJ'),
  (7, 'Binomial[m, {n}]', 'Binomial[v0,#{n}]', '\binom{m}{{n}}', 'binomial', 'Binomial'),
  (8, 'Log[{n}, w] <= Pi', 'LessEqual[Log[#{n},v0],$Pi]', '\log_{{n}}w\leq \pi', 'has-pi logarithm', 'LessEqual Log'),
  (9, '(g/h)^{n}', 'Power[Times[Power[v0,#-1],v1],#{n}]', '\left(\frac{g}{h}\right)^{{n}}', 'fraction', 'Power Times Power'),
  (10, 'Gamma[r]*{n}!', 'Times[Factorial[#{n}],Gamma[v0]]', '\Gamma\!\left(r\right) {n}!', 'factorial gamma-function', 'Times Factorial Gamma'),
  (11, 'Abs[-q] -> {n}', 'Rule[Abs[Times[#-1,v0]],#{n}]', '\left|-q\right|\to {n}', 'absolute-value', 'Rule Abs Times'),
  (12, 'p[{n}', NULL, NULL, NULL, NULL),
  (13, '  ', NULL, NULL, NULL, NULL),
  (14, 'Product[1 - p/{n}, p]', 'Product[Plus[#1,Times[#-1/{n},@0]]]', '\prod_{p} \left(1 - \frac{p}{{n}}\right)', 'product', 'Product Plus Times'),
  (15, 'Floor[x]^(-{n})', 'Power[Floor[v0],#-{n}]', '\left\lfloor x \right\rfloor^{-{n}}', 'fraction integer-part', 'Power Floor'),
  (16, 'alpha*{n}*3', 'Times[#{3n},v0]', '\alpha {n} \cdot 3', '', 'Times'),
  (17, 'Sech[{n} y] == MyFun[y, "s"]', 'Equal[Sech[Times[#{n},v0]],MyFun[v0,$"s"]]', '\operatorname{sech}\!\left({n} y\right) = \operatorname{MyFun}\!\left(y, \text{s}\right)', 'hyperbolic', 'Equal Sech Times MyFun'),
  (18, 'Hypergeometric2F1[a, b, c, {n}]', 'Hypergeometric2F1[v0,v1,v2,#{n}]', '\operatorname{Hypergeometric2F1}\!\left(a, b, c, {n}\right)', 'hypergeometric', 'Hypergeometric2F1')
), numbered AS (
  SELECT 'part-' || p_partkey AS entry_id, p_partkey, p_name AS label, p_brand AS source, p_type AS class, '$' || p_name || '$,' AS entry_latex, p_size % 7 + 2 AS n, p_partkey % 10 = 0 AS is_changed FROM part
), chosen AS (
  SELECT *, 'lhs' AS side, p_partkey % 19 AS k FROM numbered UNION ALL SELECT *, 'rhs', (p_partkey * 5 + 3) % 19 FROM numbered
), spelled AS (
  SELECT entry_id, side, label, source, class, entry_latex, is_changed, k, n, facets, ops, replace(mma, '{n}', n::VARCHAR) AS mma, replace(replace(canonical, '{n}', n::VARCHAR), '{3n}', (3 * n)::VARCHAR) AS canonical,
    replace(latex, '{n}', n::VARCHAR) AS latex FROM chosen JOIN forms USING (k) WHERE trim(mma) <> ''
), parsed AS (SELECT * FROM spelled WHERE canonical IS NOT NULL)"""
#: The formulas of the store: of entries that changed, the right side is the first form.
STORED_SQL = (
    FORMS_SQL
    + """, stored AS (
  SELECT * FROM parsed WHERE NOT (is_changed AND side = 'rhs')
  UNION ALL SELECT entry_id, 'rhs' AS side, label, source, class, entry_latex, is_changed, k, n, facets, ops, replace(mma, '{n}', n::VARCHAR), replace(canonical, '{n}', n::VARCHAR), replace(latex, '{n}', n::VARCHAR)
    FROM (SELECT * FROM numbered WHERE is_changed) JOIN (SELECT * FROM forms WHERE k = 0) ON true
)"""
)
#: The same in DuckDB.
PART_SQL = """
f AS (
  SELECT 'part-' || p_partkey AS entry_id, 'rhs' AS side, p_name AS label, p_brand AS source, p_type AS class, p_size, p_type,
    (p_size % 5 - 2) AS num, p_size % 3 = 0 AS half,
    CASE p_type WHEN 'SMALL' THEN 'Sin' WHEN 'MEDIUM' THEN 'BesselJ' WHEN 'LARGE' THEN 'Log' WHEN 'ECONOMY' THEN 'Gamma' WHEN 'PROMO' THEN 'Zeta' WHEN 'STANDARD' THEN 'Erf' END AS head
  FROM part
), g AS (
  SELECT *, '#' || num || CASE WHEN half THEN '/2' ELSE '' END AS power FROM f
), formulas AS (
  SELECT *, 'Plus[Power[v0,' || power || '],' || head || '[v1]]' AS canonical, sha256('Plus[Power[v0,' || power || '],' || head || '[v1]]') AS signature FROM g
)"""
#: Facets and tokens of those formulas, spelled out by their rules.
FACETS_SQL = (
    PART_SQL
    + """, tagged AS (
  SELECT *, CASE p_type WHEN 'SMALL' THEN 'trigonometric' WHEN 'MEDIUM' THEN 'bessel' WHEN 'LARGE' THEN 'logarithm' WHEN 'ECONOMY' THEN 'gamma-function' WHEN 'PROMO' THEN 'zeta' ELSE 'error-function' END AS f1,
    CASE WHEN num < 0 THEN 'fraction' END AS f2,
    CASE WHEN half AND abs(num) = 1 THEN 'square-root' WHEN half THEN 'nth-root' END AS f3 FROM formulas
), facets AS (
  SELECT entry_id, side, unnest(list_filter([f1, f2, f3], lambda x: x IS NOT NULL)) AS facet FROM tagged
)"""
)
TOKENS_SQL = (
    PART_SQL
    + """, tokenized AS (
  SELECT *, ['op:Plus', 'e:Plus>Power', 'p:Plus>Power>var', 'p:Plus>Power>#num', 'e:Plus>' || head, 'p:Plus>' || head || '>var', 's:' || sha256(canonical)[:16],
    'op:Power', 'e:Power>var', 'e:Power>#num', 's:' || sha256('Power[v0,' || power || ']')[:16], 'l:var', 'l:#num', 'op:' || head, 'e:' || head || '>var',
    's:' || sha256(head || '[v1]')[:16], 'l:var'] AS tokens FROM formulas
)"""
)
