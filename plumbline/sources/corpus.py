"""The driver's tables in the place of projects, graphs, usage and billing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EXTS = [".js", ".ts", ".py", ".java", ".cpp", ".go", ".tsx", ".h"]
DIRS = ["src/components", "src/api", "tests", "lib/utils", "config", "pages", "services", "types"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stem_of(doc: str):
    folder = F.get(F.array(*map(F.lit, DIRS)), (F.floor(F.col(doc) / 8) % 8).cast("int"))
    return F.concat(folder, F.lit("/"), F.col("source"), F.lit("_"), F.col(doc).cast("string"))


def ext_of(doc: str):
    return F.get(F.array(*map(F.lit, EXTS)), (F.col(doc) % 8).cast("int"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content, size_bytes, doc_id, lang): one project of all documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("corpus").alias("project"), F.concat(stem_of("doc_id"), ext_of("doc_id")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), "doc_id", "lang")


def page_files(spark: SparkSession, sf_dir: str, ext: str = ".js") -> DataFrame:
    """Pages as files; with another extension than a known one they are generic."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.lit("pages").alias("project"), F.concat(F.lit("web/page_"), F.col("page_id").cast("string"), F.lit(ext)).alias("path"), F.col("html").alias("content"), F.octet_length("html").cast("long").alias("size_bytes"), "page_id")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, src, dst): pages to the targets of their links."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.lit("pages").alias("project"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("dst")).distinct()


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, src, dst): suppliers of lines that follow each other in an order, both of 45 pieces or more."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.lead("l_suppkey").over(w).alias("to"), F.lead("l_quantity").over(w).alias("q"))
    return x.where("l_quantity >= 45 and q >= 45").select(F.lit("suppliers").alias("project"), F.format_string("S%06d", "l_suppkey").alias("src"), F.format_string("S%06d", "to").alias("dst")).distinct()


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.lit("suppliers").alias("project"), F.format_string("S%06d", "s_suppkey").alias("node"))


def supplier_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.lit("suppliers").alias("project"), F.format_string("S%06d", "s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("community"))


def supplier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a supplier in the place of a file's metrics; all whole or in quarters, so that sums are exact."""
    a = F.floor(F.abs("s_acctbal"))
    return table(spark, sf_dir, "supplier").select(F.lit("suppliers").alias("project"), F.format_string("S%06d", "s_suppkey").alias("node"), (a % 50).alias("cyclomatic"), (a % 70).alias("cognitive"), (a % 4000).cast("double").alias("halstead"), (F.col("s_suppkey") % 101).cast("double").alias("mi"), (a % 7).alias("nesting"))


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, src, dst): for each customer nation the three supplier nations with most lines."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = x.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("rank", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey"))).where("rank <= 3")
    return top.select(F.lit("trade").alias("project"), F.format_string("N%02d", "c_nationkey").alias("src"), F.format_string("N%02d", "s_nationkey").alias("dst"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.lit("trade").alias("project"), F.format_string("N%02d", "n_nationkey").alias("node"))


def import_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, src, dep, ordinal): document d imports (7 d + 1) mod N and (13 d + 5) mod N, spelled in three ways."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.count()
    src = d.select("doc_id", F.concat(stem_of("doc_id"), ext_of("doc_id")).alias("src"), F.explode(F.array(F.struct(F.lit(0).alias("ordinal"), ((7 * F.col("doc_id") + 1) % n).alias("to")), F.struct(F.lit(1).alias("ordinal"), ((13 * F.col("doc_id") + 5) % n).alias("to")))).alias("x")).select("doc_id", "src", "x.ordinal", "x.to")
    to = d.select(F.col("doc_id").alias("to"), stem_of("doc_id").alias("stem"), ext_of("doc_id").alias("ext"))
    up = F.when(F.regexp_count("src", F.lit("/")) >= 2, "../../").otherwise("../")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.concat(up, "stem")).when(F.col("doc_id") % 3 == 1, F.concat(up, "stem", "ext")).otherwise(F.substring_index("stem", "/", -1))
    return src.join(to, "to").select(F.lit("corpus").alias("project"), "src", spelled.alias("dep"), "ordinal")


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("action"), "ts", "event_id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.get(F.array(F.lit("free"), F.lit("pro"), F.lit("team")), (F.col("user_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), tier.alias("tier")).distinct()


def billing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as billing events, by their type."""
    e = F.col("event_type")
    kind = F.when(e == "signup", "checkout.session.completed").when(e == "purchase", "invoice.payment_succeeded").when(e == "error", "invoice.payment_failed").when(e == "click", "customer.subscription.updated").otherwise("customer.subscription.deleted")
    status = F.when(e == "view", "canceled").when(e == "error", "past_due").when((e == "click") & (F.col("event_id") % 4 == 0), "trialing").otherwise("active")
    price = F.when(F.col("event_id") % 3 == 0, "price_pro").when(F.col("event_id") % 3 == 1, "price_team")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), kind.alias("event_type"), status.alias("status"), price.alias("price_id"), (F.lit(1_700_000_000) + F.col("event_id") * 60).cast("long").alias("period_end"), "ts", F.col("event_id").alias("seq"))


def importing_files(spark: SparkSession, sf_dir: str, per_project: int = 500) -> DataFrame:
    """source_files in projects of `per_project` documents each; a file begins with its import statements."""
    i = import_statements(spark, sf_dir).groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "dep"))).alias("own"))
    lines = F.transform("own", lambda x: F.concat(F.lit("import '"), x["dep"], F.lit("';\n")))
    f = source_files(spark, sf_dir).join(i, "path", "left").withColumn("content", F.concat(F.coalesce(F.array_join(lines, ""), F.lit("")), F.coalesce("content", F.lit(""))))
    project = F.concat(F.lit("p"), F.floor(F.col("doc_id") / per_project).cast("string"))
    return f.select(project.alias("project"), "path", "content", F.octet_length("content").cast("long").alias("size_bytes"))


def generated_files(spark: SparkSession, n: int = 50) -> DataFrame:
    """One project of n small JavaScript files; file i imports the i % 5 files after it and branches 5 + i % 10 times."""
    rows = []
    for i in range(n):
        imports = [f"import {{ f{(i + j) % n} }} from './file{(i + j) % n}.js';" for j in range(1, i % 5 + 1)]
        branches = [f"  if (Math.random() > 0.5) {{ console.log({j}); }}" for j in range(5 + i % 10)]
        text = "\n".join([*imports, "", f"export function f{i}() {{", *branches, "}", ""])
        rows.append(("generated", f"file{i}.js", text, len(text)))
    return spark.createDataFrame(rows, "project string, path string, content string, size_bytes long")
