"""Queries of sources, sinks, text functions, formats, tokens, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.order import rank
from ..functions.rng import exact_rank, u
from ..operators import formats as O
from ..operators import joins as J
from ..operators import split
from ..operators import tokens as K
from ..operators.evaluate import mid_rank
from ..sources import readers, sinks
from ..sources.scratch import folder
from .views import ASSIGNED, IDS, LABELS, QA, SAMPLES, SEED, TURNS, answers, assigned, ids, query, questions, samples, sql_assigned, sql_u, table

IDLABEL = "id long, label string"


# Sources and sinks: write, read back, and compare with the table itself.


@query("io01_jsonl", f"WITH {IDS} SELECT id, label, domain FROM ids")
def _(spark, d):
    path = folder(spark, "jsonl")
    ids(spark, d).write.json(path)
    return readers.jsonl(spark, path, "id long, label string, domain string").drop(readers.CORRUPT)


@query("io02_json_array", f"WITH {IDS} SELECT label, count(*) AS n FROM ids GROUP BY label")
def _(spark, d):
    path = folder(spark, "array")
    # One file holds one list: its rows are the few cells of an aggregate.
    cells = ids(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = cells.agg(F.to_json(F.collect_list(F.struct("label", "n"))).alias("value"))
    whole.coalesce(1).write.text(path)
    return readers.json_array(spark, path, "label string, n long")


@query("io03_tsv", "SELECT c_custkey::VARCHAR AS id, c_name || chr(10) || '\"q\"' || chr(9) || c_mktsegment AS text FROM customer")
def _(spark, d):
    path = folder(spark, "tsv")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat("c_name", F.lit('\n"q"\t'), "c_mktsegment").alias("text"))
    c.write.csv(path, sep="\t", header=True, quote='"', escape='"', quoteAll=True)
    return readers.tsv(spark, path, ["id", "text"])


@query("io04_wrapped_array", "SELECT n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def _(spark, d):
    path = folder(spark, "wrapped")
    n = table(spark, d, "nation")
    one = n.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))).alias("items"))
    # One object a file, as such files are: a folder for each region.
    one.withColumn("part", F.col("region")).write.partitionBy("part").json(path)
    return readers.wrapped_array(spark, path, "region long, items array<struct<id:long,name:string>>", "items").drop("part")


@query("io05_client_shards", f"WITH {ASSIGNED} SELECT id, label, client AS client_id FROM assigned")
def _(spark, d):
    path = folder(spark, "shards")
    own = assigned(spark, d).select("id", "label", F.col("client").alias("client_id"))
    sinks.client_shards(own, path, SEED)
    back = spark.read.schema("id long, label string").option("basePath", path).json(path)
    return back.select("id", "label", F.col("client_id").cast("int").alias("client_id")) if "client_id" in back.columns else spark.read.schema("id long, label string, client_id int").option("basePath", path).json(path)


@query("io06_plain_text", "SELECT c_name || ' ' || c_mktsegment AS text FROM customer")
def _(spark, d):
    path = folder(spark, "text")
    table(spark, d, "customer").select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("value")).write.text(path)
    return readers.text_lines(spark, path)


@query("io07_file_listing", f"WITH {IDS} SELECT DISTINCT label FROM ids")
def _(spark, d):
    path = folder(spark, "files")
    ids(spark, d).write.partitionBy("label").json(path)
    found = readers.file_listing(spark, path, "*.json")
    return found.filter("length > 0").select(F.regexp_extract("path", "label=([^/]*)/", 1).alias("label")).distinct()


@query("io08_shard_sink", f"WITH {ASSIGNED} SELECT client AS client_id, count(*) AS n, count(DISTINCT label) AS labels FROM assigned GROUP BY client")
def _(spark, d):
    path = folder(spark, "sink")
    sinks.client_shards(assigned(spark, d).select("id", "label", F.col("client").alias("client_id")), path, SEED)
    back = spark.read.schema("id long, label string, client_id int").json(path)
    return back.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))


@query("io09_overwrite", f"WITH {ASSIGNED} SELECT client AS client_id, count(*) AS n FROM assigned WHERE client < 5 GROUP BY client")
def _(spark, d):
    path = folder(spark, "over")
    own = assigned(spark, d).select("id", "label", F.col("client").alias("client_id"))
    sinks.client_shards(own, path, SEED)
    sinks.client_shards(own.filter("client_id < 5"), path, SEED, overwrite=True)
    return spark.read.schema("id long, label string, client_id int").json(path).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


@query("io10_manifest", f"WITH {IDS} SELECT 'split' AS dataset_type, count(*)::VARCHAR AS n, 2::INT AS steps FROM ids")
def _(spark, d):
    n = ids(spark, d).count()
    m = sinks.manifest(spark, folder(spark, "manifest"), "split", {"n": n, "alpha": 0.5}, [{"step": "split"}])
    return sinks.with_step(m, "missing", rate=0.3).select("dataset_type", F.col("parameters")["n"].alias("n"), F.size("transform_history").alias("steps"))


@query("io11_report", f"WITH {ASSIGNED} SELECT client::VARCHAR AS client, label, count(*)::VARCHAR AS n FROM assigned GROUP BY client, label")
def _(spark, d):
    path = folder(spark, "report")
    sinks.report(assigned(spark, d).groupBy("client", "label").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.csv(path, header=True)


@query("io12_quarantine", f"WITH {SAMPLES} SELECT CASE WHEN img IS NULL THEN 'img' ELSE 'quality' END AS error, count(*) AS n FROM samples WHERE img IS NULL OR quality IS NULL GROUP BY 1")
def _(spark, d):
    path = folder(spark, "bad")
    sinks.quarantine(samples(spark, d).select("id", "img", "quality"), path, {"img": F.col("img").isNotNull(), "quality": F.col("quality").isNotNull()})
    return spark.read.schema("id long, error string").json(path).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("io13_split_file", f"WITH {IDS} SELECT count(*) AS n FROM ids WHERE id % 5 = 0")
def _(spark, d):
    path = folder(spark, "splits")
    ids(spark, d).filter("id % 5 = 0").write.json(f"{path}/v2_val_questions")
    ids(spark, d).filter("id % 5 <> 0").write.json(f"{path}/v2_train_questions")
    found = readers.split_file(spark, path, "val", ("{split}.json", "v2_{split}_questions"))
    return spark.read.schema(IDLABEL).json(found).agg(F.count(F.lit(1)).alias("n"))


# Text and records.


@query("p01_normalise", """SELECT CASE WHEN c_custkey % 7 = 0 THEN 'train_' || lpad(c_custkey::VARCHAR, 6, '0') ELSE 'c' || c_custkey END AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS img, c_mktsegment AS text, c_nationkey::INT AS label,
    CASE WHEN c_custkey % 5 = 0 THEN 'img' END AS error FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    raw = c.select(F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" c"), F.col("c_custkey").cast("string"))).alias("sample_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("image"), F.col("c_mktsegment").alias("sentence"), F.col("c_nationkey").cast("string").alias("labels"), "c_custkey")
    return O.normalise_records(raw, F.col("c_custkey"))


NAMES = "n AS (SELECT p_partkey AS id, ' ' || upper(p_name) || '-' || p_type || ' (' || p_brand || '_x)! ' AS raw FROM part)"


def names(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("p_name"), F.lit("-"), "p_type", F.lit(" ("), "p_brand", F.lit("_x)! ")).alias("raw"))


@query("p02_label_strict", f"WITH {NAMES} SELECT id, regexp_replace(regexp_replace(regexp_replace(translate(lower(trim(raw)), '- ', '__'), '[^a-z_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS label FROM n")
def _(spark, d):
    return names(spark, d).select("id", T.label_strict("raw").alias("label"))


@query("p03_label_light", f"WITH {NAMES} SELECT id, translate(lower(trim(raw)), '- ', '__') AS label FROM n")
def _(spark, d):
    return names(spark, d).select("id", T.label_light("raw").alias("label"))


@query("p04_label_words", f"WITH {NAMES} SELECT id, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS label FROM n")
def _(spark, d):
    return names(spark, d).select("id", T.label_words("raw").alias("label"))


@query("p05_label_spaced", f"WITH {NAMES} SELECT id, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM n")
def _(spark, d):
    return names(spark, d).select("id", T.label_spaced("raw").alias("label"))


TWEETS = """tweets AS (SELECT doc_id AS id, source AS file, CASE WHEN doc_id % 3 = 0 THEN 'RT @u: RT @v ' ELSE '' END || replace(coalesce(text, ''), chr(10), ' ') || CASE WHEN doc_id % 4 = 0 THEN ' https://a.b/c?d=' || doc_id ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN ' #tag &amp; &lt;x&gt;' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN ' itâ€™s' ELSE '' END AS text FROM documents)"""


def tweets(spark, d):
    k = F.col("doc_id")
    part = lambda m, s: F.when(k % m == 0, s).otherwise("")
    return table(spark, d, "documents").select(
        k.alias("id"), F.col("source").alias("file"),
        F.concat(part(3, "RT @u: RT @v "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.when(k % 4 == 0, F.concat(F.lit(" https://a.b/c?d="), k.cast("string"))).otherwise(""), part(5, " #tag &amp; &lt;x&gt;"), part(6, " itâ€™s")).alias("text"),
    )


SQL_CLEAN = r"""trim(regexp_replace(replace(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), 'â€™', ''''), 'Â', ''), '(https?://|www\.)\S+', '', 'g')), '^(RT\s+@\w+:?\s*)+', ''), '#', ''), '\s+', ' ', 'g'))"""


@query("p06_clean_tweet", f"WITH {TWEETS} SELECT id, md5({SQL_CLEAN}) AS h, length({SQL_CLEAN}) AS n FROM tweets")
def _(spark, d):
    clean = T.clean_tweet("text")
    return tweets(spark, d).select("id", F.md5(clean).alias("h"), F.length(clean).cast("long").alias("n"))


@query("p07_clean_counts", f"""WITH {TWEETS} SELECT file, count(*) AS n, sum(({SQL_CLEAN} <> text)::INT)::BIGINT AS changed, sum(len(regexp_extract_all(text, '(https?://|www\\.)\\S+')))::BIGINT AS urls, sum(regexp_matches(text, '^(RT\\s+@\\w+:?\\s*)+')::INT)::BIGINT AS retweets,
    sum(len(text) - len(replace(text, '#', '')))::BIGINT AS hashes, sum((len(text) - len(replace(text, 'â€™', ''))) // 3 + len(text) - len(replace(text, 'Â', '')))::BIGINT AS mojibake FROM tweets GROUP BY ROLLUP (file)""")
def _(spark, d):
    counts = T.clean_counts("text")
    names = ("changed", "urls", "retweets", "hashes", "mojibake")
    # A rollup expands its rows; so texts are read into sums by file first, and the few sums rolled up.
    files = tweets(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"), *[F.sum(counts[c]).alias(c) for c in names])
    return files.rollup("file").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


INSTRUCTION, QUESTION = "Look at the post.", "Which label fits?"
CONVS = f"""convs AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN '<image>' || chr(10) || '{INSTRUCTION}' || chr(10) || replace(text, chr(10), ' ') || chr(10) || chr(10) || '{QUESTION}' || chr(10) || '(A) yes' || chr(10) || '(B) not sure' || chr(10) || 'Answer:' END) AS prompt FROM conversations GROUP BY conv_id)"""


def convs(spark, d):
    c = table(spark, d, "conversations").filter("turn = 0").groupBy("conv_id").agg(F.max(F.concat(F.lit(f"<image>\n{INSTRUCTION}\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(f"\n\n{QUESTION}\n(A) yes\n(B) not sure\nAnswer:"))).alias("prompt"))
    return table(spark, d, "conversations").select("conv_id").distinct().join(c, "conv_id", "left")


FIRST = "trim(replace(text, chr(10), ' '), ' ' || chr(9))"
SEGMENTS = f"""seg AS (SELECT conv_id, max('RT @u: ' || replace(text, chr(10), ' ') || ' #tag &amp; https://a.b/c') AS text FROM conversations WHERE turn = 0 GROUP BY conv_id),
    clean AS (SELECT conv_id, text, {SQL_CLEAN} AS c FROM seg)"""


def segments(spark, d):
    """Prompts with first turns as tweets; every fifth lacks its question."""
    text = F.concat(F.lit("RT @u: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" #tag &amp; https://a.b/c"))
    c = table(spark, d, "conversations").filter("turn = 0").groupBy("conv_id").agg(F.max(text).alias("text"))
    end = F.when(F.col("conv_id") % 5 == 0, "").otherwise(f"\n\n{QUESTION}\n(A) yes")
    return c.select("conv_id", F.concat(F.lit(f"<image>\n{INSTRUCTION}\n"), "text", end).alias("prompt"))


@query("p08_segment_cleaning", f"""WITH {SEGMENTS} SELECT conv_id, (conv_id % 5 = 0)::INT AS skipped, md5('<image>' || chr(10) || '{INSTRUCTION}' || chr(10) || CASE WHEN conv_id % 5 = 0 THEN text ELSE c || chr(10) || '{QUESTION}' || chr(10) || '(A) yes' END) AS h FROM clean""")
def _(spark, d):
    prompt, skipped = T.clean_segment("prompt", "^Which .*[?]$")
    return segments(spark, d).select("conv_id", skipped.alias("skipped"), F.md5(prompt).alias("h"))


@query("p09_prompt_text", f"WITH c AS (SELECT conv_id, max(text) AS text FROM conversations WHERE turn = 0 GROUP BY conv_id) SELECT conv_id, {FIRST} AS text FROM c")
def _(spark, d):
    return convs(spark, d).filter("prompt is not null").select("conv_id", T.prompt_text("prompt", INSTRUCTION, QUESTION).alias("text"))


@query("p10_infer_modalities", f"WITH {SAMPLES} SELECT id, CASE WHEN id % 4 = 0 THEN FALSE ELSE img IS NOT NULL END AS has_img, CASE WHEN id % 6 = 0 THEN TRUE WHEN id % 3 = 0 THEN TRUE ELSE length(trim(text)) > 0 END AS has_text FROM samples")
def _(spark, d):
    s = samples(spark, d)
    prompt = F.when(F.col("id") % 3 == 0, "with " + QUESTION).otherwise("none")
    a, b = O.inferred_modalities(F.when(F.col("id") % 4 == 0, False), F.when(F.col("id") % 6 == 0, True), F.col("img"), prompt, QUESTION, "Text only?", F.col("text"))
    return s.select("id", a.alias("has_img"), b.alias("has_text"))


@query("p11_pattern", f"WITH {SAMPLES} SELECT id, CASE WHEN img IS NOT NULL AND quality = 1 THEN 'multimodal' WHEN img IS NOT NULL THEN 'image_only' WHEN quality = 1 THEN 'text_only' ELSE 'no_modality' END AS pattern FROM samples")
def _(spark, d):
    return samples(spark, d).select("id", O.pattern(F.col("img").isNotNull(), F.coalesce(F.col("quality") == 1, F.lit(False))).alias("pattern"))


OPTIONS = ["de", "en", "fr"]
SUFFIX = "Answer with the option's letter from the given choices directly."
SQL_PROMPT = f"""CASE WHEN img IS NOT NULL THEN '<image>' || chr(10) ELSE '' END || '{INSTRUCTION}' || chr(10) || CASE WHEN domain <> 'src0' THEN domain || chr(10) ELSE '' END || '{QUESTION}' || chr(10) || '(A) de' || chr(10) || '(B) en' || chr(10) || '(C) fr' || chr(10) || '{SUFFIX.replace(chr(39), chr(39) * 2)}'"""


def prompt_col():
    return O.choice_prompt(F.col("img").isNotNull(), F.col("domain") != "src0", F.col("domain"), OPTIONS, INSTRUCTION, QUESTION, SUFFIX)


@query("p12_choice_prompt", f"WITH {SAMPLES} SELECT id, {SQL_PROMPT} AS prompt FROM samples")
def _(spark, d):
    return samples(spark, d).select("id", prompt_col().alias("prompt"))


ANSWER = "CASE label WHEN 'de' THEN '(A) de' WHEN 'en' THEN '(B) en' WHEN 'fr' THEN '(C) fr' END"


@query("p13_conversation", f"WITH {SAMPLES}, c AS (SELECT id, {SQL_PROMPT} AS prompt, {ANSWER} AS answer FROM samples) SELECT id, CASE WHEN answer IS NOT NULL THEN 2 ELSE 0 END::INT AS turns, CASE WHEN answer IS NOT NULL THEN prompt END AS asked, answer FROM c")
def _(spark, d):
    own = samples(spark, d).withColumn("c", O.choice_conversation(prompt_col(), F.col("label"), OPTIONS))
    return own.select("id", F.when(F.col("c").isNotNull(), F.size("c")).otherwise(0).alias("turns"), O.first_user(F.col("c")).alias("asked"), O.assistant(F.col("c")).alias("answer"))


@query("p14_task_histogram", f"WITH {IDS} SELECT coalesce(CASE label WHEN 'de' THEN 'A' WHEN 'en' THEN 'B' END, label) AS answer, count(*) AS n FROM ids GROUP BY 1")
def _(spark, d):
    options = F.broadcast(spark.createDataFrame([("de", "A"), ("en", "B")], "label string, letter string"))
    own = ids(spark, d).join(options, "label", "left")
    return own.groupBy(F.coalesce("letter", "label").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("p15_binary_format", f"WITH {SAMPLES} SELECT id, CASE toxic WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS answer, CASE WHEN toxic IS NULL THEN 1 ELSE 2 END::INT AS turns FROM samples")
def _(spark, d):
    c = O.binary_conversation(F.col("domain"), F.col("toxic"), required=False)
    return samples(spark, d).withColumn("c", c).select("id", O.assistant(F.col("c")).alias("answer"), F.size("c").alias("turns"))


@query("p16_qa_format", "SELECT o_orderkey AS id, '<image>' || chr(10) || 'Answer the following visual question using the image. Keep the answer short and precise, without extra explanation.' || chr(10) || 'Question: ' || o_orderpriority || ' of ' || o_orderstatus || chr(10) || 'Answer:' AS prompt, o_orderstatus AS answer FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    q = F.concat(F.lit(" "), "o_orderpriority", F.lit(" \r\n of "), "o_orderstatus", F.lit("\r"))
    c = O.qa_conversation(q, F.concat(F.lit(" "), "o_orderstatus"))
    return o.withColumn("c", c).select(F.col("o_orderkey").alias("id"), O.first_user(F.col("c")).alias("prompt"), O.assistant(F.col("c")).alias("answer"))


@query("p17_instruction_format", "SELECT p_partkey AS id, 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request. ### Instruction: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' ### Input: ' || p_type ELSE '' END || ' ### Response: ' AS prompt FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), O.instruction_prompt(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ")).alias("prompt"))


@query("p18_turns", f"WITH {TURNS} SELECT conv_id, arg_min(CASE WHEN lower(role) IN ('user', 'human') THEN text END, CASE WHEN lower(role) IN ('user', 'human') THEN turn END) AS prompt, arg_max(CASE WHEN lower(role) IN ('assistant', 'gpt') THEN text END, CASE WHEN lower(role) IN ('assistant', 'gpt') THEN turn END) AS answer FROM turns GROUP BY conv_id")
def _(spark, d):
    # A conversation may hold repeated turn numbers; each (conv, turn) counts once.
    return O.flat_turns(table(spark, d, "conversations"))


@query("p19_placeholders", f"WITH {TURNS} SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace('<image>' || chr(10) || text || '<IMAGE_3>' || chr(10) || chr(10) || chr(10) || chr(10) || role, '<image(_\\d+)?>', '', 'gi'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM turns")
def _(spark, d):
    c = table(spark, d, "conversations")
    raw = F.concat(F.lit("<image>\n"), "text", F.lit("<IMAGE_3>\n\n\n\n"), "role")
    clean = F.regexp_replace(T.strip_placeholders(raw), r"^[ \n]+|[ \n]+$", "")
    return c.select("conv_id", "turn", "role", clean.alias("text"))


@query("p20_option_table", f"WITH {CONVS} SELECT conv_id, 'yes' AS a, 'not sure' AS b FROM convs WHERE prompt IS NOT NULL")
def _(spark, d):
    return convs(spark, d).filter("prompt is not null").withColumn("o", T.option_table("prompt")).select("conv_id", F.col("o")["A"].alias("a"), F.col("o")["B"].alias("b"))


RAW = "r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 5 WHEN 0 THEN '(B) no' WHEN 1 THEN 'Not Sure!' WHEN 2 THEN 'I say yes' WHEN 3 THEN 'C' ELSE 'other' END AS raw FROM lineitem)"


def raws(spark, d):
    m = F.col("l_linenumber") % 5
    raw = F.when(m == 0, "(B) no").when(m == 1, "Not Sure!").when(m == 2, "I say yes").when(m == 3, "C").otherwise("other")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), raw.alias("raw"))


@query("p21_labels_to_letters", f"WITH {RAW} SELECT id, CASE raw WHEN '(B) no' THEN 'B' WHEN 'Not Sure!' THEN 'C' WHEN 'I say yes' THEN 'A' WHEN 'C' THEN 'C' ELSE raw END AS letter FROM r")
def _(spark, d):
    return raws(spark, d).select("id", O.labels_to_letters(F.col("raw"), ["yes", "no", "not sure"]).alias("letter"))


@query("p22_letters_to_labels", f"WITH {RAW} SELECT id, CASE raw WHEN 'C' THEN '(C) not sure' ELSE raw END AS label FROM r")
def _(spark, d):
    return raws(spark, d).select("id", O.letters_to_labels(F.col("raw"), ["yes", "no", "not sure"]).alias("label"))


@query("p23_letter_constraint", f"WITH {CONVS} SELECT conv_id, regexp_replace(prompt, '\\s*Answer:$', '') || chr(10) || chr(10) || 'Respond with ONLY one uppercase option letter from {{A, B}}.' || chr(10) || 'Do not output the option text, explanation, or punctuation.' || chr(10) || 'Answer:' AS prompt FROM convs WHERE prompt IS NOT NULL")
def _(spark, d):
    own = convs(spark, d).filter("prompt is not null")
    return own.select("conv_id", T.letter_constraint("prompt", F.map_keys(T.option_table("prompt"))).alias("prompt"))


@query("p24_paths", f"WITH {IDS} SELECT id, 'root/' || domain || '/a/' || id AS joined, '/new/' || label || '/' || id AS rerooted, 'COCO_val_' || lpad(id::VARCHAR, 12, '0') || '.jpg' AS numbered FROM ids")
def _(spark, d):
    i = F.col("id").cast("string")
    return ids(spark, d).select("id", T.joined_path(F.lit("root/"), F.concat("domain", F.lit("\\a")), i).alias("joined"), T.rerooted(F.concat(F.lit("C:\\x\\data_image\\"), "label", F.lit("\\"), i), "data_image", "/new").alias("rerooted"), T.numbered_image(F.lit("val"), "id").alias("numbered"))


@query("p25_presence", f"WITH {SAMPLES} SELECT CASE WHEN id % 9 = 0 THEN 'dev_' || lpad(id::VARCHAR, 6, '0') ELSE id::VARCHAR END AS id, img IS NOT NULL AS has_image, coalesce(length(trim(text)) > 0, FALSE) AS has_text FROM samples")
def _(spark, d):
    s = samples(spark, d).select(F.when(F.col("id") % 9 != 0, F.col("id")).alias("id"), F.col("id").alias("ordinal"), F.lit("dev").alias("split"), "img", "text")
    return O.presence(s)


TSV = ["event_name", "tweet_id", "image_id", "tweet_text", "image", "label", "label_text", "label_image", "label_text_image"]


def tsv_rows(spark, d):
    c = table(spark, d, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        F.lit("flood").alias("event_name"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey").cast("string")).alias("tweet_id"), F.col("c_nationkey").cast("string").alias("image_id"), F.concat("c_name", F.lit(" #x  http://t.co/a")).alias("tweet_text"),
        F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("img\\"), "c_name")).alias("image"), *[seg.alias(x) for x in ("label", "label_text", "label_image", "label_text_image")],
    )


SEGMENTS = ["automobile", "building", "furniture", "machinery"]


@query("p26_standardise", """SELECT c_custkey || '_' || c_nationkey AS sample_id, lower(c_mktsegment) AS label, replace(c_name, '#', '') || ' x' AS text, CASE WHEN c_custkey % 4 <> 0 THEN 'data/img/' || c_name ELSE 'data' END AS image_path, c_custkey % 4 <> 0 AS image_available,
    CASE WHEN lower(c_mktsegment) NOT IN ('automobile', 'building', 'furniture', 'machinery') THEN 'label' END AS error FROM customer WHERE c_custkey % 10 <> 0""")
def _(spark, d):
    return O.standardise(tsv_rows(spark, d), "label", SEGMENTS).select("sample_id", "label", "text", "image_path", "modalities.image_available", "error")


@query("p27_training_samples", "SELECT c_custkey || '_' || c_nationkey AS sample_id, replace(c_name, '#', '') || ' x' AS text, lower(c_mktsegment) AS label, c_custkey % 4 <> 0 AS image_available, TRUE AS text_available FROM customer WHERE c_custkey % 10 <> 0 AND lower(c_mktsegment) IN ('automobile', 'building', 'furniture', 'machinery')")
def _(spark, d):
    std = O.standardise(tsv_rows(spark, d), "label", SEGMENTS).filter("error is null")
    return O.records_back(O.training_samples(std, SEGMENTS, INSTRUCTION, QUESTION, SUFFIX), SEGMENTS, INSTRUCTION, QUESTION)


@query("p28_vqa_answer", "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 6 WHEN 0 THEN '1000 apple' WHEN 1 THEN '2 woman' WHEN 2 THEN 'it don''t box' WHEN 3 THEN 'glass city' WHEN 4 THEN '3 5 bus' ELSE 'dish' END AS answer FROM lineitem")
def _(spark, d):
    m = F.col("l_linenumber") % 6
    raw = F.when(m == 0, "The 1,000 Apples.").when(m == 1, "two women!").when(m == 2, "it dont boxes").when(m == 3, "a glass, cities").when(m == 4, "3.5 buses").otherwise("an dishes?")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), T.vqa_answer(raw).alias("answer"))


# Tokens: lower-case ASCII words of the page addresses and part names.
PART_TEXT = "pt AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type || ' ' || p_brand) AS text FROM part)"
TOKENS = f"{PART_TEXT}, tk AS (SELECT id, regexp_extract_all(text, '[a-z0-9_'']+|[.,!?;:()]') AS t FROM pt), ct AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM tk) GROUP BY token HAVING count(*) >= 5), vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM ct)"
WHOLE = f"{TOKENS}, lg AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS k FROM tk), enc AS (SELECT id, list(coalesce(token_id, 0)::INT ORDER BY k) AS ids FROM lg LEFT JOIN vocab USING (token) GROUP BY id)"
ENC = f"{TOKENS}, lg AS (SELECT id, unnest(list_slice(t, 1, 64)) AS token, unnest(range(least(len(t), 64))) AS k FROM tk), enc AS (SELECT id, list(coalesce(token_id, 0)::INT ORDER BY k) AS ids FROM lg LEFT JOIN vocab USING (token) GROUP BY id)"


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


def encoded(spark, d, most=None):
    p = parts(spark, d)
    return K.encoded(p, K.vocabulary(p), most)


@query("p29_vocabulary", f"WITH {TOKENS} SELECT token, n, token_id::INT AS token_id FROM vocab")
def _(spark, d):
    return K.vocabulary(parts(spark, d))


@query("p30_encode", f"WITH {ENC} SELECT id, ids || list_resize([]::INT[], greatest(64 - len(ids), 0), 1) AS input_ids FROM enc")
def _(spark, d):
    return encoded(spark, d, 64).select("id", K.padded(F.col("input_ids"), 64, 1).alias("input_ids"))


@query("p31_supervised", f"WITH {WHOLE} SELECT id, list_slice(ids || ids || [2], 1, 129) AS input_ids, list_slice([-100 for x in ids] || ids || [2], 1, 129) AS labels FROM enc")
def _(spark, d):
    a, b = K.supervised(F.col("input_ids"), F.col("input_ids"), 2, 129)
    return encoded(spark, d).select("id", a.alias("input_ids"), b.alias("labels"))


@query("p32_multi_turn", f"WITH {WHOLE} SELECT id, ids || [9] || ids || [9] AS input_ids, [-100 for x in ids] || [-100] || ids || [9] AS labels FROM enc")
def _(spark, d):
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("input_ids").alias("ids")), F.struct(F.lit("assistant").alias("role"), F.col("input_ids").alias("ids")))
    own = encoded(spark, d).withColumn("turns", turns)
    a, b = K.multi_turn(F.col("turns"), 9)
    return own.select("id", a.alias("input_ids"), b.alias("labels"))


@query("p33_batches", f"WITH {WHOLE}, r AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM enc), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS len FROM r) SELECT id, batch, [1 for x in ids] || list_resize([]::INT[], len - len(ids), 0) AS mask, ids || list_resize([]::INT[], len - len(ids), 0) AS input_ids FROM m")
def _(spark, d):
    return K.batches(encoded(spark, d), 16, 100).select("id", F.col("batch").cast("long").alias("batch"), "mask", "input_ids")


BY_LENGTH = "r AS (SELECT *, (row_number() OVER (ORDER BY len(ids) DESC, id) - 1) AS rank FROM enc), m AS (SELECT *, rank // 16 AS batch, max(len(ids)) OVER (PARTITION BY rank // 16) AS len FROM r)"


@query("p33b_batches_by_length", f"WITH {WHOLE}, {BY_LENGTH} SELECT id, batch, list_resize([]::INT[], len - len(ids), 0) || ids AS input_ids, list_resize([]::INT[], len - len(ids), 0) || [1 for x in ids] AS mask FROM m")
def _(spark, d):
    return K.batches(encoded(spark, d), 16, 100, by_length=True, left=True).select("id", F.col("batch").cast("long").alias("batch"), "input_ids", "mask")


CUT = f"{WHOLE}, c AS (SELECT id, list_slice(ids, 1, floor(len(ids) * 0.8)::INT) AS prompt, list_slice(ids, floor(len(ids) * 0.8)::INT + 1, len(ids)) AS answer FROM enc)"


@query("p34_prefix_cut", f"""WITH {CUT}, r AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM c), m AS (SELECT *, max(len(prompt)) OVER (PARTITION BY batch) AS width, row_number() OVER (PARTITION BY batch ORDER BY len(prompt) DESC, id) - 1 AS place FROM r)
    SELECT id, batch, place, list_resize([]::INT[], width - len(prompt), 0) || prompt AS prompt, answer FROM m""")
def _(spark, d):
    prompt, answer = K.prefix_cut(F.col("input_ids"))
    cut = encoded(spark, d).select("id", prompt.alias("prompt"), answer.alias("answer"))
    return K.prompt_batches(cut, 16).select("id", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"), "prompt", "answer")


@query("p35_hashed_bag", f"WITH {PART_TEXT}, w AS (SELECT id, unnest(string_split(text, ' ')) AS w FROM pt), b AS (SELECT id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS bucket, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL) SELECT id, bucket, round(n / sum(n) OVER (PARTITION BY id), 9) AS weight FROM b")
def _(spark, d):
    return K.hashed_bag(parts(spark, d), 64).withColumn("weight", F.round("weight", 9))


@query("p36_channel_statistics", "WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT vec_id, avg(x) AS m, stddev_samp(x) AS s FROM l GROUP BY vec_id) SELECT round(avg(m), 8) AS mean, round(avg(s), 8) AS sd FROM r")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return K.channel_statistics(e, "x").select(F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


# Filters.


@query("f01_required_fields", f"WITH {SAMPLES} SELECT count(*) AS n, count(*) FILTER (WHERE img IS NULL) AS no_img, count(*) FILTER (WHERE quality IS NULL) AS no_quality, count(*) FILTER (WHERE img IS NOT NULL AND quality IS NOT NULL) AS kept FROM samples")
def _(spark, d):
    return samples(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("img").isNull()).alias("no_img"), F.count_if(F.col("quality").isNull()).alias("no_quality"), F.count_if(F.col("img").isNotNull() & F.col("quality").isNotNull()).alias("kept"))


@query("f02_target_set", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(urgent, "l_orderkey", "left_semi")


@query("f05_fraction_split", f"WITH {IDS}, r AS (SELECT id, row_number() OVER (ORDER BY {sql_u(SEED, 'frac', 'id')}, id) - 1 AS rank, count(*) OVER () AS n FROM ids) SELECT id, rank < floor(0.9 * n) AS train FROM r")
def _(spark, d):
    own = ids(spark, d)
    n = own.agg(F.count(F.lit(1)).alias("n"))
    ranked = exact_rank(own.withColumn("_u", u(SEED, "frac", "id")), [], "_u", ["id"])
    return ranked.join(F.broadcast(n)).select("id", (F.col("rank") < F.floor(0.9 * F.col("n"))).alias("train"))


@query("f06_hold_out", f"WITH {ASSIGNED}, r AS (SELECT id, client, row_number() OVER (PARTITION BY client ORDER BY {sql_u(SEED, 'hold', 'id')}, id) - 1 AS rank, count(*) OVER (PARTITION BY client) AS n FROM assigned) SELECT id, client, rank < floor(0.8 * n) AS train FROM r")
def _(spark, d):
    own = assigned(spark, d)
    n = own.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    ranked = exact_rank(own.withColumn("_u", u(SEED, "hold", "id")), ["client"], "_u", ["id"])
    return ranked.join(F.broadcast(n), "client").select("id", "client", (F.col("rank") < F.floor(0.8 * F.col("n"))).alias("train"))


# Joins.


@query("j01_primary_answer", f"""WITH {QA}, g AS (SELECT question_id, answer, count(*) AS n, min(ordinal) AS first FROM answers GROUP BY ALL), b AS (SELECT question_id, arg_max(answer, (n, -first, answer)) AS best, sum(n)::BIGINT AS n_answers FROM g GROUP BY question_id),
    chosen AS (SELECT l_orderkey AS question_id, arg_max(CASE WHEN l_linenumber % 3 > 0 THEN l_linestatus || ' chosen' ELSE '' END, (l_linenumber, l_linestatus)) AS choice FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1)
    SELECT q.question_id, CASE WHEN choice <> '' THEN choice ELSE best END AS answer, coalesce(n_answers, 0) AS n_answers, choice IS NOT NULL OR best IS NOT NULL AS annotated FROM questions q LEFT JOIN b USING (question_id) LEFT JOIN chosen USING (question_id)""")
def _(spark, d):
    # A fifth of the questions have annotations of their own, several each: the last one counts, and an empty choice falls back to the answers.
    li = table(spark, d, "lineitem").filter("l_orderkey % 5 = 0")
    choice = F.when(F.col("l_linenumber") % 3 > 0, F.concat("l_linestatus", F.lit(" chosen"))).otherwise("")
    annotations = li.select(F.col("l_orderkey").alias("question_id"), F.struct("l_linenumber", "l_linestatus").alias("ordinal"), choice.alias("choice"))
    out = J.questions_with_answers(questions(spark, d), annotations, answers(spark, d))
    return out.select("question_id", "answer", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "annotated")


@query("j02_category", "SELECT c_custkey AS id, coalesce(n_name, 'unknown') AS supercategory FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def _(spark, d):
    cat = table(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("supercategory"))
    return J.with_category(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("category_id")), cat).select("id", "supercategory")


@query("j03_records", f"WITH {SAMPLES}, {sql_assigned('samples')} SELECT id, client, label, img, coalesce(quality, -1) AS quality FROM assigned")
def _(spark, d):
    placed = assigned(spark, d).select("id", "client")
    return J.records_of(placed, samples(spark, d)).select("id", "client", "label", "img", F.coalesce("quality", F.lit(-1)).alias("quality"))


PLACED = f"placed AS (SELECT DISTINCT o_custkey AS image_id, floor({sql_u(SEED, 'unit', 'o_custkey')} * 10)::INT AS client FROM orders)"


@query("j04_expand_units", f"WITH {QA}, {PLACED} SELECT client, count(*) AS annotations, count(DISTINCT q.question_id) AS questions FROM placed JOIN questions q USING (image_id) JOIN answers a ON a.question_id = q.question_id GROUP BY client")
def _(spark, d):
    units = questions(spark, d).select("image_id").distinct().withColumn("client", F.floor(u(SEED, "unit", "image_id") * 10).cast("int"))
    _, notes = J.expand_units(units, questions(spark, d), answers(spark, d))
    return notes.groupBy("client").agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct("question_id").alias("questions"))


@query("j05_id_differences", f"WITH {IDS}, s AS (SELECT id + 7 AS id FROM ids WHERE id % 3 <> 0), m AS (SELECT 'missing' AS side, id FROM ids WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT DISTINCT 'extra', id FROM s WHERE id NOT IN (SELECT id FROM ids)) SELECT side, count(*) AS n, list_slice(list(id ORDER BY id), 1, 5) AS examples FROM m GROUP BY side")
def _(spark, d):
    a = ids(spark, d)
    return J.id_differences(a, a.filter("id % 3 <> 0").select((F.col("id") + 7).alias("id")))


@query("j06_label_conflicts", f"WITH {IDS} SELECT id, label AS label_a, 'en' AS label_b FROM ids WHERE label <> 'en' ORDER BY id LIMIT 10")
def _(spark, d):
    a = ids(spark, d)
    return J.label_conflicts(a, a.withColumn("label", F.lit("en")))


@query("j07_overlap", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return J.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "id")


@query("j08_missing_paths", f"WITH {SAMPLES} SELECT id, img AS path FROM samples WHERE img IS NOT NULL AND id % 5 <> 0 AND id % 7 <> 0")
def _(spark, d):
    s = samples(spark, d).select("id", F.col("img").alias("path"))
    here = s.filter("path is not null and id % 5 = 0").select(F.concat(F.lit("/a/"), "path").alias("path"))
    there = s.filter("path is not null and id % 7 = 0").select(F.concat(F.lit("/b/"), "path").alias("path"))
    return J.missing_paths(s, here.unionByName(there), ["/a/", "/b/"])


@query("j11_quota_range", f"WITH {IDS}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_u(SEED, 'quota', 'id')}, id) - 1 AS rank FROM ids) SELECT id, label, (rank // 10)::INT AS client FROM r WHERE rank < 50")
def _(spark, d):
    quotas = [(label, c, 10 * c, 10 * c + 10) for label in LABELS for c in range(5)]
    return split.quota_assign(ids(spark, d), quotas, SEED).select("id", "label", "client")


# Windows, order and sets that no other query shows.


@query("w04_last_per_key", "SELECT l_orderkey AS id, max(l_linenumber) AS ordinal, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS answer FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("answer"))
    top = li.groupBy("id", "ordinal").agg(F.max("answer").alias("answer"))
    return J.last_per_key(top, ["id"], "ordinal")


@query("w05_first_per_key", "SELECT l_orderkey AS id, min(l_linenumber) AS ordinal, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS answer FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("answer"))
    return J.first_per_key(li.groupBy("id", "ordinal").agg(F.min("answer").alias("answer")), ["id"], "ordinal")


@query("w06_mid_rank", "WITH c AS (SELECT l_returnflag AS label, l_quantity AS s, count(*) AS n FROM lineitem GROUP BY ALL) SELECT label, s, coalesce(sum(n) OVER (PARTITION BY label ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM c")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return mid_rank(c).select("label", "s", "rank")


@query("t01_top_and_bottom", "(SELECT 'top' AS side, o_orderkey AS id, o_totalprice AS x FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    top = o.orderBy(F.desc("x"), "id").limit(10).withColumn("side", F.lit("top"))
    return top.unionByName(o.orderBy("x", "id").limit(10).withColumn("side", F.lit("bottom"))).select("side", "id", "x")


@query("t02_numeric_order", "SELECT name, row_number() OVER (ORDER BY k IS NULL, k, name) AS place FROM (SELECT name, try_cast(regexp_extract(name, '(\\d+)', 1) AS INT) AS k FROM (SELECT DISTINCT CASE WHEN o_custkey % 10 = 0 THEN 'client_x' ELSE 'client_' || (o_custkey % 25) END AS name FROM orders))")
def _(spark, d):
    o = table(spark, d, "orders")
    n = o.select(F.when(F.col("o_custkey") % 10 == 0, "client_x").otherwise(F.concat(F.lit("client_"), (F.col("o_custkey") % 25).cast("string"))).alias("name")).distinct()
    number = F.expr("try_cast(regexp_extract(name, '([0-9]+)', 1) as int)")
    ranked = rank(n.withColumn("k", number), [], [F.asc_nulls_last("k"), F.col("name")])
    return ranked.select("name", (F.col("rank") + 1).alias("place"))


@query("u01_union_of_shards", f"WITH {ASSIGNED} SELECT client, count(*) AS n, min(id) AS first FROM assigned WHERE client IN (1, 4, 7) GROUP BY client")
def _(spark, d):
    own = assigned(spark, d)
    a, b, c = (own.filter(F.col("client") == k) for k in (1, 4, 7))
    return a.unionByName(b).unionByName(c).groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("u02_intersect", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "id")
    return J.overlap(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), "id")


@query("u03_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("id")))
