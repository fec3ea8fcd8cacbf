"""Annotations: validation, overlaps, labels per token, windows, decoding, splits, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import first_by
from ..functions.text import each, find_all, strip

# fixed values: the labels, and the types of documents in the order of their ids
LABELS = ["TITLE", "AUTHORITY", "DATE", "CONTACT", "AUDIENCE", "ELIGIBILITY", "DOCUMENT"]
BIO = ["O"] + [f"{p}-{x}" for x in LABELS for p in "BI"]
TYPES = ["Circular", "Notification", "Ordinance", "Draft Rule"]
STRING_LABELS = {"document_title": "TITLE", "issuing_authority": "AUTHORITY", "issue_date": "DATE"}


def entity_error(text: Column, e: Column) -> Column:
    """The first thing wrong with an entity struct(label, start, end, text) whose fields are all there; null if nothing is. In
    this order: not empty, inside the text, not blank, text equal. An unknown label is reported beside it."""
    body = text.substr(e["start"] + 1, e["end"] - e["start"])
    return (
        F.when(e["end"] <= e["start"], "EMPTY_SPAN")
        .when((e["start"] < 0) | (e["end"] > F.length(text)), "INVALID_OFFSET")
        .when(strip(body) == "", "EMPTY_SPAN")
        .when(e["text"].isNotNull() & (e["text"] != body), "TEXT_MISMATCH")
    )


def validate(df: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, entity_index, error_type), row-wise. A record that lacks its key, text or entities gives one row with index -1 for
    each; without text or entities nothing else is looked at. An entity gives MISSING_FIELD for each of label, start and end that
    it lacks, and then no more; else UNKNOWN_LABEL and what entity_error finds. Of the entities inside the text (their text may
    differ) those that reach into the next one by start are OVERLAPPING."""
    base = df.select(F.col(key).alias("_key"), F.col("text").alias("_t"), F.col("entities").alias("_e"))
    whole = F.col("_t").isNotNull() & F.col("_e").isNotNull()
    row = lambda i, e: F.struct(i.cast("int").alias("entity_index"), e.alias("error_type"))
    lacks = lambda x: x["label"].isNull() | x["start"].isNull() | x["end"].isNull()
    top = F.array(*[row(F.lit(-1), F.when(F.col(c).isNull(), "MISSING_FIELD")) for c in ("_key", "_t", "_e")])
    parts = [F.flatten(F.transform("_e", lambda x, i: F.array(*[row(i, F.when(x[c].isNull(), "MISSING_FIELD")) for c in ("label", "start", "end")])))]
    parts.append(F.transform("_e", lambda x, i: row(i, F.when(~lacks(x) & ~x["label"].isin(LABELS), "UNKNOWN_LABEL"))))
    parts.append(F.transform("_e", lambda x, i: row(i, F.when(~lacks(x), entity_error(F.col("_t"), x)))))
    indexed = F.transform("_e", lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x["end"].alias("e"), (~lacks(x) & F.coalesce(entity_error(F.col("_t"), x), F.lit("")).isin("", "TEXT_MISMATCH")).alias("ok")))
    base = base.withColumn("_o", F.when(whole, F.array_sort(F.filter(indexed, lambda x: x["ok"]))))
    over = F.transform("_o", lambda x, k: row(x["i"], F.when(F.get("_o", k + 1)["s"] < x["e"], "OVERLAPPING")))
    none = F.array().cast("array<struct<entity_index:int,error_type:string>>")
    every = F.concat(top, *[F.when(whole, x).otherwise(none) for x in (*parts, over)])
    return base.select("_key", F.explode(F.filter(every, lambda x: x["error_type"].isNotNull())).alias("_x")).select(F.col("_key").alias(key), "_x.*")


def validation_report(df: DataFrame, errors: DataFrame, key: str = "document_id", parse_errors: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row: documents, invalid and valid ones, errors, warnings (documents without entities), parse_errors, is_clean (no
    error and no line that can't be read; with ``strict`` no warning either)."""
    bad = errors.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    j = df.join(bad, F.col(key).eqNullSafe(F.col("_k")), "left")
    r = j.agg(F.count("*").alias("documents"), F.count_if(F.col("_n").isNotNull()).alias("invalid"), F.count_if(F.col("_n").isNull()).alias("valid"), F.coalesce(F.sum("_n"), F.lit(0)).alias("errors"), F.count_if(F.size("entities") == 0).alias("warnings"))
    lines = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("parse_errors")) if parse_errors is None else parse_errors.agg(F.count_if(F.col("error").isNotNull()).alias("parse_errors"))
    clean = (F.col("errors") == 0) & (F.col("parse_errors") == 0)
    return r.join(lines, F.lit(True)).withColumn("is_clean", clean & (F.col("warnings") == 0) if strict else clean)  # one row each


def keep_disjoint(spans: Column) -> Column:
    """Of an array of struct(start, end, label), in order of start, those that begin at or behind the end of the last one kept."""
    kind = "array<struct<start:int,end:int,label:string>>"
    del spans
    return F.expr(f"""aggregate(array_sort(spans), named_struct('e', -1, 'a', cast(array() as {kind})),
        (s, x) -> if(x.start >= s.e and x.end > x.start, named_struct('e', x.end, 'a', concat(s.a, array(x))), s), s -> s.a)""")


def align_values(df: DataFrame, columns: dict[str, str], text: str = "text") -> Column:
    """array<struct<start,end,label>>: the first place of each non-empty column value in the text, by label."""
    out = []
    for column, label in columns.items():
        at = F.expr(f"locate({column}, {text})")
        out.append(F.when((F.col(column) != "") & (at > 0), F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(column)).cast("int").alias("end"), F.lit(label).alias("label"))))
    del df
    return F.array_compact(F.array(*out))


def words(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, ord, start, end, token): the test double of a tokenizer, one token per run of non-blank characters."""
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_t")).transform(each, ["_key"], find_all("_t", r"\S+"), "_w", "ord").select(F.col("_key").alias(key), "ord", "_w.start", "_w.end", F.col("_w.value").alias("token"))


def word_ids(text: Column, starts: Column) -> Column:
    """For an array of places in the text the numbers of the words (runs of non-blank characters) they belong to."""
    return F.transform(starts, lambda at: F.regexp_count(text.substr(F.lit(1), at + 1), F.lit(r"\S+")) - 1)


def bio_array(tokens: Column, spans: Column) -> Column:
    """The labels of an array of tokens, struct(start, end, word_id), by an array of spans, struct(start, end, label): of the
    first span by start in which a token starts, B- for the first piece of every word, I- for further pieces (same word_id as
    the token before). Tokens without a word_id are special, those of no width are outside. Within the row: no shuffle."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))

    def labelled(held: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            inside = F.get(F.filter(held, lambda s: (s["start"] <= t["start"]) & (t["start"] < s["end"])), F.lit(0))["label"]
            goes_on = F.get(tokens, i - 1)["word_id"].eqNullSafe(t["word_id"]) & (i > 0)
            out = t["word_id"].isNull() | (t["end"] <= t["start"]) | inside.isNull()
            return F.when(out, "O").otherwise(F.concat(F.when(goes_on, "I-").otherwise("B-"), inside))

        return F.transform(tokens, one)

    return F.get(F.transform(F.array(ordered), labelled), F.lit(0))


def bio_labels(tokens: DataFrame, spans: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds label, by bio_array, to token rows (key, ord, start, end, word_id). A document's tokens meet in one row."""
    t = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "word_id"))).alias("_t"))
    s = spans.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("start", "end", "label")).alias("_s"))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    j = t.join(s, F.col(key) == F.col("_k"), "left").withColumn("_s", F.coalesce(F.col("_s").cast("array<struct<start:int,end:int,label:string>>"), none))
    rows = j.select(key, F.explode(F.arrays_zip("_t", bio_array(F.col("_t"), F.col("_s")).alias("_l"))).alias("_z"))
    return rows.select(key, "_z._t.*", F.col("_z._l").alias("label"))


def type_id(kind: Column) -> Column:
    """The number of a document's type; 0 for unknown ones."""
    at = F.array_position(F.array(*[F.lit(t) for t in TYPES]), kind)
    return F.coalesce(F.when(at > 0, at - 1), F.lit(0)).cast("int")


def label_id(label: Column) -> Column:
    """The number of a label among BIO."""
    return (F.array_position(F.array(*[F.lit(x) for x in BIO]), label) - 1).cast("int")


def training_chunks(records: DataFrame, columns: dict[str, str] = STRING_LABELS, key: str = "document_id", kind: str = "document_type", size: int = 510, stride: int = 128, tokens: str | None = None) -> DataFrame:
    """(key, chunk_index, tokens, label_ids, attention_mask, doc_label_id) from annotation records (key, text, entities, string
    labels): entities, or where there are none the first places of the string ``columns`` (column: label); overlapping ones are
    left out; tokens labelled; windows. Records without text, or with neither entities nor string labels, give nothing.
    ``tokens``: the column array<struct<start,end,word_id,token>> of a tokenizer; without it runs of non-blank characters. Row-wise."""
    base = records.withColumn("_text", F.col("text")).filter(F.length("_text") > 0)
    own = F.transform(F.filter("entities", lambda e: e["label"].isNotNull() & (e["start"] >= 0) & (e["end"] > e["start"]) & (e["end"] <= F.length("_text"))), lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["label"].alias("label")))
    base = base.withColumn("spans", F.when(F.size("entities") > 0, own).otherwise(align_values(None, columns, "_text")))
    labelled = F.size("entities") > 0
    for c in columns:
        labelled = labelled | F.coalesce(F.col(c) != "", F.lit(False))
    base = base.filter(labelled).withColumn("_spans", keep_disjoint(F.col("spans")))
    made = F.col(tokens) if tokens else F.transform(find_all("_text", r"\S+"), lambda w, i: F.struct(w["start"].alias("start"), w["end"].alias("end"), i.alias("word_id"), w["value"].alias("token")))
    base = base.withColumn("_tok", made).withColumn("_lab", bio_array(F.col("_tok"), F.col("_spans")))
    ready = base.select(key, F.transform("_tok", lambda t: t["token"]).alias("tokens"), F.transform("_lab", label_id).alias("label_ids"), type_id(F.col(kind)).alias("doc_label_id"))
    return token_chunks(ready, key, size, stride, keep=["doc_label_id"])


def chunk_splits(chunks: DataFrame, splits: DataFrame, key: str = "document_id") -> DataFrame:
    """The chunks with the split of their document."""
    return chunks.join(splits.select(F.col(key).alias("_k"), "split"), F.col(key) == F.col("_k")).drop("_k")


def exact_splits(docs: DataFrame, key: str = "document_id", validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split): in the order of a hash the first max(1, round(n * test)) documents are for testing, the next max(1,
    round(n * validation)) for validation, the rest for training. Ranks come from counts per hash bucket, so no task orders all."""
    u = docs.select(key).distinct().withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_b", F.shiftright("_h", 52))
    sizes = u.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("_b").alias("_c"), F.coalesce("_before", F.lit(0)).alias("_before"))  # at most 4096 rows
    n = F.broadcast(sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all")))
    ranked = u.join(before, F.col("_b") == F.col("_c")).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).join(n, F.lit(True))
    share = lambda x: F.greatest(F.lit(1), F.bround(F.col("_all") * x).cast("long"))
    return ranked.select(key, F.when(F.col("_r") <= share(test), "test").when(F.col("_r") <= share(test) + share(validation), "validation").otherwise("train").alias("split"))


def tokens_holding(df: DataFrame, part: str, tokens: str = "tokens") -> DataFrame:
    """(token, count): the tokens that hold a string, in any case."""
    return df.select(F.explode(tokens).alias("token")).filter(F.contains(F.lower("token"), F.lit(part.lower()))).groupBy("token").agg(F.count("*").alias("count"))


def add_entity(entities: Column, label: Column, start: Column, end: Column, text: Column) -> Column:
    """The entities with one more, in order of start."""
    new = F.struct(label.cast("string").alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.substr(start + 1, end - start).alias("text"))
    every = F.concat(F.coalesce(entities, F.array().cast("array<struct<label:string,start:int,end:int,text:string>>")), F.array(new))
    return F.transform(F.array_sort(F.transform(every, lambda e: F.struct(e["start"].alias("s"), e["end"].alias("t"), e.alias("e")))), lambda x: x["e"])


def delete_entity(entities: Column, index: Column) -> Column:
    """The entities without the one at ``index`` (from 0); unchanged if there is none."""
    return F.filter(entities, lambda _, i: i != index)


def progress(docs: DataFrame, annotated: DataFrame, key: str = "document_id") -> DataFrame:
    """One row: documents, annotated ones (with one entity at least), the rest."""
    done = annotated.filter(F.size("entities") > 0).select(F.col(key).alias("_k")).distinct()
    j = docs.select(key).distinct().join(done, F.col(key) == F.col("_k"), "left")
    return j.agg(F.count("*").alias("documents"), F.count("_k").alias("annotated"), F.count_if(F.col("_k").isNull()).alias("remaining"))


def windows(n: Column, size: int = 510, stride: int = 128) -> Column:
    """array<struct<chunk_index,window_start,window_end>>: windows of ``size`` tokens, each begins ``stride`` before the end of the last; one at least."""
    step = size - stride
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("window_start"), F.least(n, i * step + size).cast("int").alias("window_end")))


def token_chunks(df: DataFrame, key: str = "document_id", size: int = 510, stride: int = 128, keep: list[str] | None = None) -> DataFrame:
    """Token and label arrays of every document cut into windows, [CLS] and [SEP] added, label id -100 at both. df: (key, tokens, label_ids)."""
    w = df.withColumn("_w", F.explode(windows(F.size("tokens"), size, stride)))
    part = lambda c: F.slice(c, F.col("_w.window_start") + 1, F.col("_w.window_end") - F.col("_w.window_start"))
    ids = F.concat(F.array(F.lit(-100)), part("label_ids"), F.array(F.lit(-100)))
    toks = F.concat(F.array(F.lit("[CLS]")), part("tokens"), F.array(F.lit("[SEP]")))
    return w.select(key, "_w.chunk_index", toks.alias("tokens"), ids.alias("label_ids"), F.transform(toks, lambda _: F.lit(1)).alias("attention_mask"), *(keep or []))


def decode(df: DataFrame, keys: list[str], labels: str = "labels", scores: str | None = None) -> DataFrame:
    """(keys, first_token, last_token, label, score): entities of label arrays. B- or a change of label opens one, I- of the same
    label goes on; the score is the least of its tokens' (1 without scores). Row-wise fold."""
    kind = "array<struct<first:int,last:int,label:string,score:double>>"
    arr = F.arrays_zip(F.col(labels).alias("l"), (F.col(scores) if scores else F.transform(labels, lambda _: F.lit(1.0))).alias("p"))
    fold = f"""aggregate(_z, named_struct('i', 0, 'o', '', 'a', cast(array() as {kind})),
      (s, x) -> case
        when x.l is null or x.l = 'O' then named_struct('i', s.i + 1, 'o', '', 'a', s.a)
        when x.l like 'I-%' and s.o = substring(x.l, 3) then named_struct('i', s.i + 1, 'o', s.o, 'a',
          concat(slice(s.a, 1, size(s.a) - 1), array(named_struct('first', s.a[size(s.a) - 1].first, 'last', s.i, 'label', s.o, 'score', least(s.a[size(s.a) - 1].score, x.p)))))
        else named_struct('i', s.i + 1, 'o', substring(x.l, 3), 'a', concat(s.a, array(named_struct('first', s.i, 'last', s.i, 'label', substring(x.l, 3), 'score', x.p)))) end, s -> s.a)"""
    out = df.select(*keys, arr.alias("_z")).select(*keys, F.explode(F.expr(fold)).alias("_d"))
    return out.select(*keys, F.col("_d.first").alias("first_token"), F.col("_d.last").alias("last_token"), F.col("_d.label").alias("label"), F.col("_d.score").alias("score"))


def split_documents(docs: DataFrame, key: str = "document_id", validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split): every document by a hash of its key; its share of the hash range decides, so no order over all rows is
    needed and new rows move none. Shares are met in expectation."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return docs.select(key).distinct().withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train"))


def latest(df: DataFrame, key: str, at: str, tie: list[str]) -> DataFrame:
    """The last version of every key: greatest ``at``, nulls first, then greatest ties."""
    return first_by(df, [key], [F.desc_nulls_last(at), *[F.desc_nulls_last(c) for c in tie]])


def nth_place(text: str, part: str, n: int) -> Column:
    """0-based place of the n-th occurrence of a fixed string, null if there are fewer."""
    import re

    return F.try_element_at(find_all(text, re.escape(part)), F.lit(n))["start"]
