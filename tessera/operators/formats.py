"""Sample records, prompts and conversations as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def field(df: DataFrame, *names: str) -> Column:
    """The first of ``names`` that the table has (resolved once), else null."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None))


def normalise_records(df: DataFrame, ordinal: Column | None = None) -> DataFrame:
    """``id, img, text, label, error``: candidate fields resolved; a blank id
    becomes ``train_`` and its six-digit ordinal (or a hash of the row where
    there is no ordinal); ``error`` names a missing image or label."""
    given, img, text, label = (field(df, *n) for n in (("id", "sample_id"), ("img", "image"), ("text", "sentence"), ("label", "labels")))
    number = F.lpad((ordinal if ordinal is not None else F.pmod(F.xxhash64(*df.columns), F.lit(10**6))).cast("string"), 6, "0")
    blank = F.coalesce(F.trim(given.cast("string")), F.lit("")) == ""
    no_img = F.coalesce(F.trim(img.cast("string")), F.lit("")) == ""
    error = F.when(no_img, "img").when(label.isNull(), "label")
    return df.select(F.when(blank, F.concat(F.lit("train_"), number)).otherwise(F.trim(given.cast("string"))).alias("id"), img.cast("string").alias("img"), F.coalesce(text, F.lit("")).alias("text"), label.cast("int").alias("label"), error.alias("error"))


def pattern(image: Column, text: Column, names: tuple[str, str, str, str] = ("multimodal", "image_only", "text_only", "no_modality")) -> Column:
    """Name of the (image, text) flags."""
    return F.when(image & text, names[0]).when(image, names[1]).when(text, names[2]).otherwise(names[3])


def inferred_modalities(image_flag: Column, text_flag: Column, image: Column, prompt: Column, question_both: str, question_text: str, extracted: Column) -> tuple[Column, Column]:
    """Metadata flags win; else the image field, and the question in the prompt,
    and last the extracted text."""
    has_image = F.coalesce(image_flag, F.coalesce(F.length(F.trim(image)) > 0, F.lit(False)))
    by_question = F.when(prompt.contains(question_both) | prompt.contains(question_text), True)
    return has_image, F.coalesce(text_flag, by_question, F.length(F.trim(extracted)) > 0)


def choice_prompt(image: Column, text: Column, content: Column, options: list[str], instruction: str, question: str, suffix: str) -> Column:
    """Prompt with the parts that the pattern has; ``<image>`` first."""
    letters = "\n".join(f"({chr(65 + i)}) {o}" for i, o in enumerate(options))
    return F.concat_ws("\n", F.when(image, F.lit("<image>")), F.lit(instruction), F.when(text, content), F.lit(question), F.lit(letters), F.lit(suffix))


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def choice_conversation(prompt: Column, label: Column, options: list[str]) -> Column:
    """User prompt and assistant ``(E) label``; null for an unknown label."""
    answers = F.create_map(*[F.lit(x) for i, o in enumerate(options) for x in (o, f"({chr(65 + i)}) {o}")])
    answer = F.try_element_at(answers, label)
    return F.when(answer.isNotNull(), F.array(turn("user", prompt), turn("assistant", answer)))


#: Prompts of the binary and the question task.
BINARY_PROMPT = "Given the image and text, determine whether the meme is hateful.\n\nAnswer with only:\nyes\nor\nno.\n\nText:\n"
QA_PROMPT = "<image>\nAnswer the following visual question using the image. Keep the answer short and precise, without extra explanation.\nQuestion: {question}\nAnswer:"
#: Fixed value: the head of an instruction prompt.
INSTRUCTION_HEAD = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request. ### Instruction: "
)


def binary_conversation(text: Column, label: Column, required: bool = True) -> Column:
    """Fixed question with the text; 0 and 1 become no and yes.  Without a label
    only the user turn, where none is required; otherwise null."""
    prompt = F.concat(F.lit(BINARY_PROMPT), text)
    answer = F.when(label == 0, "no").when(label == 1, "yes")
    one = F.when(label.isNull(), F.array(turn("user", prompt))) if not required else F.lit(None)
    return F.when(answer.isNotNull(), F.array(turn("user", prompt), turn("assistant", answer))).otherwise(one)


def qa_conversation(question: Column, answer: Column, template: str = QA_PROMPT) -> Column:
    """Question on one line in the template; null where the answer is blank."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(question, "\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    prompt = F.replace(F.lit(template), F.lit("{question}"), F.array_join(lines, " "))
    return F.when(F.length(F.trim(answer)) > 0, F.array(turn("user", prompt), turn("assistant", F.trim(answer))))


def instruction_prompt(instruction: Column, given: Column) -> Column:
    """Two templates, by whether there is an input."""
    some = F.coalesce(F.length(F.trim(given)) > 0, F.lit(False))
    middle = F.when(some, F.concat(F.lit(" ### Input: "), F.trim(given))).otherwise("")
    return F.concat(F.lit(INSTRUCTION_HEAD), F.trim(instruction), middle, F.lit(" ### Response: "))


def first_user(turns: Column) -> Column:
    return F.get(F.filter(turns, lambda t: F.lower(t["role"]).isin("user", "human")), 0)["content"]


def assistant(turns: Column, last: bool = True) -> Column:
    found = F.filter(turns, lambda t: F.lower(t["role"]).isin("assistant", "gpt"))
    return F.get(found, F.size(found) - 1 if last else F.lit(0))["content"]


def flat_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, prompt, answer`` of a flat turn table: the first user turn and
    the last assistant turn."""
    user, bot = F.lower("role").isin("user", "human"), F.lower("role").isin("assistant", "gpt")
    return turns.groupBy("conv_id").agg(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("prompt"), F.max_by(F.when(bot, F.col("text")), F.when(bot, F.col("turn"))).alias("answer"))


def labels_to_letters(answer: Column, options: list[str]) -> Column:
    """The option's letter of an answer: a leading letter, the exact name, else a
    name that it contains; unchanged where none fits."""
    valid = "".join(chr(65 + i) for i in range(len(options)))
    own = T.label_spaced(answer)
    lead = F.nullif(F.regexp_extract(answer, rf"^\s*\(?([{valid}])(?:\)|\.|\s*$)", 1), F.lit(""))
    names = [(chr(65 + i), T.plain_words(o)) for i, o in enumerate(options)]
    exact = [F.when(own == n, F.lit(k)) for k, n in names]
    part = [F.when(own.contains(n), F.lit(k)) for k, n in names]
    return F.coalesce(lead, *exact, *part, answer)


def letters_to_labels(answer: Column, options: list[str]) -> Column:
    """``(X) name`` of a lone letter, with or without brackets; others stay."""
    full = F.create_map(*[F.lit(x) for i, o in enumerate(options) for x in (chr(65 + i), f"({chr(65 + i)}) {o}")])
    letter = F.regexp_extract(answer, r"^\s*\(?([A-Z])\)?\s*$", 1)
    return F.coalesce(F.try_element_at(full, letter), answer)


def presence(df: DataFrame) -> DataFrame:
    """``id, has_image, has_text`` (a blank text is absent); ids by split."""
    return df.select(F.coalesce(F.col("id").cast("string"), F.concat_ws("_", "split", F.lpad(F.col("ordinal").cast("string"), 6, "0"))).alias("id"), F.col("img").isNotNull().alias("has_image"), F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)).alias("has_text"))


def standardise(df: DataFrame, chosen: str, labels: list[str], root: str = "data") -> DataFrame:
    """TSV rows to nested records with the chosen label column; rows without an
    id are dropped, an unsupported label is marked in ``error``."""
    label = T.label_strict(chosen)
    return df.filter(F.coalesce(F.trim("tweet_id"), F.lit("")) != "").select(
        F.concat_ws("_", "tweet_id", "image_id").alias("sample_id"), "tweet_id", "event_name", T.clean_tweet("tweet_text").alias("text"), F.col("tweet_text").alias("raw_text"),
        F.col("image").alias("image_rel_path"), T.joined_path(F.lit(root), F.col("image")).alias("image_path"), label.alias("label"), F.lit(chosen).alias("label_source"),
        F.struct(*[T.label_strict(c).alias(c) for c in ("label", "label_text", "label_image", "label_text_image")]).alias("label_candidates"),
        F.struct(F.coalesce(F.length(F.trim("image")) > 0, F.lit(False)).alias("image_available"), F.coalesce(F.length(F.trim("tweet_text")) > 0, F.lit(False)).alias("text_available")).alias("modalities"),
        F.when(~F.coalesce(label.isin(labels), F.lit(False)), F.lit("label")).alias("error"),
    )


def training_samples(records: DataFrame, options: list[str], instruction: str, question: str, suffix: str) -> DataFrame:
    """Standard records to training samples, masked by their modality flags."""
    image, text = F.col("modalities.image_available"), F.col("modalities.text_available")
    prompt = choice_prompt(image, text, F.col("text"), options, instruction, question, suffix)
    meta = F.struct(F.col("label"), F.struct(image.alias("image"), text.alias("text"), pattern(image, text).alias("pattern")).alias("modalities"), F.array().cast("array<string>").alias("transformations"))
    return records.select(F.col("sample_id").alias("id"), F.when(image, F.col("image_path")).alias("image"), F.when(text, F.col("text")).otherwise("").alias("text"), choice_conversation(prompt, F.col("label"), options).alias("conversations"), meta.alias("metadata"))


def records_back(samples: DataFrame, options: list[str], instruction: str, question: str) -> DataFrame:
    """Training samples back to ``sample_id, text, label`` and flags: the text
    field, else the text in the prompt; the answer, else the metadata."""
    from .evaluate import strict_label

    letters = {chr(65 + i): o for i, o in enumerate(options)}
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), T.prompt_text(first_user(F.col("conversations")), instruction, question))
    label = F.coalesce(strict_label(assistant(F.col("conversations")), letters), F.col("metadata.label"))
    return samples.select(F.col("id").alias("sample_id"), text.alias("text"), label.alias("label"), F.col("metadata.modalities.image").alias("image_available"), F.col("metadata.modalities.text").alias("text_available"))
