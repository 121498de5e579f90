"""Word counts, ranked vocabularies and id encoding by joins."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions import segments as S
from textloom.functions.text import MARKER, char_ids, characters, clean_words, split_words

UNK = "<UNK>"
# The ids that every token vocabulary starts with.
SPECIALS = ("<UNK>", "<BOS>", "<EOS>", "<PAD>", "<MASK>")


def document_words(docs: DataFrame, kind: str = "letters", lower: bool = True, text: str = "text") -> DataFrame:
    """doc_id, pos, word of every cleaned word."""
    return docs.select("doc_id", F.posexplode(clean_words(F.col(text), kind, lower)).alias("pos", "word"))


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def top_words(counts: DataFrame, k: int, min_freq: int = 1) -> DataFrame:
    """The ``k`` most frequent words, ties by word; a distributed top-k."""
    return counts.filter(F.col("freq") >= min_freq).orderBy(F.desc("freq"), "word").limit(k)


def ranked_vocab(counts: DataFrame, k: int, min_freq: int = 1) -> DataFrame:
    """word, id, freq: ``k - 1`` words from id 1 on, and the unknown word with id 0."""
    best = top_words(counts, k - 1, min_freq)
    ids = best.withColumn("id", F.row_number().over(W.orderBy(F.desc("freq"), "word")))  # k rows
    unknown = counts.sparkSession.createDataFrame([(UNK, 0, 0)], "word string, id int, freq long")
    return ids.select("word", "id", "freq").unionByName(unknown)


def weighted_counts(segmented: DataFrame) -> DataFrame:
    """segment, freq: each segment's word frequencies summed; from (segs, freq) rows."""
    return segmented.select(F.explode("segs").alias("segment"), "freq").groupBy("segment").agg(F.sum("freq").alias("freq"))


def root_vocab(segmented: DataFrame, k: int, min_freq: int = 1) -> DataFrame:
    """Ranked first segments, weighted by word frequency."""
    counts = segmented.groupBy(F.get("segs", F.lit(0)).alias("word")).agg(F.sum("freq").alias("freq"))
    return ranked_vocab(counts, k, min_freq)


def token_vocab(segment_counts: DataFrame, chars: list[str], priority: list[str], size: int, min_freq: int = 1) -> DataFrame:
    """token, id: specials, characters, priority pieces, then segments by frequency up to ``size``."""
    spark = segment_counts.sparkSession
    fixed = list(dict.fromkeys([*SPECIALS, *chars, *priority]))[:size]
    known = spark.createDataFrame(list(enumerate(fixed)), "place int, token string")
    fresh = segment_counts.join(F.broadcast(known.select(F.col("token").alias("segment"))), "segment", "left_anti")
    best = fresh.filter(F.col("freq") >= min_freq).orderBy(F.desc("freq"), "segment").limit(size - len(fixed))
    place = F.row_number().over(W.orderBy(F.desc("freq"), "segment")) + (len(fixed) - 1)  # size rows
    return known.select("token", F.col("place").alias("id")).unionByName(best.select(F.col("segment").alias("token"), place.alias("id")))


def with_ids(words: DataFrame, vocab: DataFrame, default: int = 0) -> DataFrame:
    """``words`` with ``id``; the planner broadcasts the vocabulary if it is small."""
    return words.join(vocab.select("word", "id"), "word", "left").withColumn("id", F.coalesce("id", F.lit(default)))


def encode_with_chars(tokens: DataFrame, vocab: DataFrame, unk: int = 0) -> DataFrame:
    """doc_id, pos, sub, token, id: known tokens whole, others by character, else unknown.

    ``tokens`` has doc_id, pos, token; ``vocab`` token, id. The word marker before
    an unknown token stays with its first character.
    """
    known = vocab.select("token", "id")
    hit = tokens.join(known, "token", "left")
    whole = hit.filter("id is not null").select("doc_id", "pos", F.lit(0).alias("sub"), "token", "id")
    bare = F.regexp_replace("token", f"^{MARKER}", "")
    chars = F.transform(characters(bare), lambda ch, i: F.when((i == 0) & F.col("token").startswith(MARKER), F.concat(F.lit(MARKER), ch)).otherwise(ch))
    missed = hit.filter("id is null").select("doc_id", "pos", F.posexplode(chars).alias("sub", "token"))
    spelled = missed.join(known, "token", "left").withColumn("id", F.coalesce("id", F.lit(unk)))
    return whole.unionByName(spelled.select("doc_id", "pos", "sub", "token", "id"))


def encode_distinct(words: DataFrame, vocab: DataFrame, unk: int = 0) -> DataFrame:
    """word, ids of each distinct word: its token's id, else its characters' ids, else unknown.

    The first column of ``words`` is looked at once a distinct word, so running
    text joins the result once, whatever its length.
    """
    marked = words.select("word").distinct().select(F.col("word").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit(MARKER), F.col("word")).alias("token"))
    spelled = encode_with_chars(marked, vocab, unk)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("sub", "id"))), lambda x: x["id"])
    return spelled.groupBy(F.col("doc_id").alias("word")).agg(ids.alias("ids"))


#: Documents that are encoded before their ids leave Python.
BATCH_DOCS = 64
#: Words of them that are looked up at a time.
PART_WORDS = 1 << 20


def _encoder(docs: DataFrame, vocab: DataFrame, key: str, unk: int):
    """From batches of (doc_id, words) to batches of (doc_id, ids), for :func:`encode_documents`."""
    shared = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in vocab.select(key, "id").collect()})
    joined = docs.schema["words"].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        whole = {t if key == "word" else t[1:]: i for t, i in known.items() if key == "word" or t.startswith(MARKER)}
        names, whole_ids = pa.array(list(whole), pa.string()), np.array([*whole.values(), unk], dtype=np.int32)
        inner, first = (np.full(sys.maxunicode + 1, unk, dtype=np.int32) for _ in range(2))  # ids by code point
        for t, i in known.items():
            if len(t) == 1:
                inner[ord(t)] = i
            elif len(t) == 2 and t[0] == MARKER:
                first[ord(t[1])] = i

        def looked_up(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """The ids of all words, and the number of ids of each."""
            place = pc.fill_null(pc.index_in(words, names), -1).to_numpy()
            if key == "word":
                return whole_ids[place], np.ones(len(place), np.int64)
            hit = place >= 0
            n = np.where(hit, 1, pc.fill_null(pc.utf8_length(words), 0).to_numpy())
            starts = np.cumsum(n) - n
            missed = words.filter(pa.array(~hit))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(missed)], pa.int32()), pc.fill_null(missed, "")), "")[0].as_py()
            chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            ids, spelled = np.empty(n.sum(), np.int32), np.ones(n.sum(), bool)
            ids[starts[hit]], spelled[starts[hit]] = whole_ids[place[hit]], False
            ids[spelled] = inner[chars]
            head = n[~hit] > 0
            ids[starts[~hit][head]] = first[chars[(np.cumsum(n[~hit]) - n[~hit])[head]]]
            return ids, n

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                some = batch.slice(at, BATCH_DOCS)
                lists = pc.split_pattern(some.column("words"), " ") if joined else some.column("words")
                words, ends = lists.flatten(), _ends(lists)
                if joined:
                    kept = pc.binary_length(words).to_numpy() > 0
                    words, ends = words.filter(pa.array(kept)), np.concatenate([[0], kept]).cumsum()[ends]
                parts = [looked_up(words.slice(i, PART_WORDS)) for i in range(0, len(words), PART_WORDS)]
                ids = np.concatenate([np.empty(0, np.int32), *[part for part, _ in parts]])
                before = np.concatenate([[0], *[n for _, n in parts]]).cumsum()  # ids before each word
                ends = before[ends]
                found = pa.RecordBatch.from_arrays([some.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["doc_id", "ids"])
                # Not filtered by Spark, which would clean the text for the filter and again for the words.
                yield found.filter(pa.array(np.diff(ends) > 0))

    return run


def _decoder(vocab: DataFrame, skip: list[int]):
    """From batches of (doc_id, ids) to batches of (doc_id, text), for :func:`decode_documents`."""
    shared = vocab.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in vocab.select("id", "token").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(shared.value), dtype=np.int64)
        tokens = pa.array([*(shared.value[i].replace(MARKER, " ") for i in known.tolist()), ""], pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                some = batch.slice(at, BATCH_DOCS)
                lists = some.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                kept = ~np.isin(ids, skip)
                ends = np.concatenate([[0], kept]).cumsum()[_ends(lists)]
                ids = ids[kept]
                place = np.searchsorted(known, ids)
                place[np.append(known, -1)[place] != ids] = len(known)  # the empty token
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(pa.array(place))), "")
                out = pa.RecordBatch.from_arrays([some.column("doc_id"), pc.utf8_trim(texts, " ")], ["doc_id", "text"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    return run


def _ends(lists: pa.Array) -> np.ndarray:
    """0 and where each list ends among the flattened values; null is an empty list."""
    return np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)]).cumsum()


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode_documents(docs: DataFrame, vocab: DataFrame, key: str = "token", unk: int = 0) -> DataFrame:
    """doc_id, ids of documents with ``words``, in order: no row a word, no shuffle.

    ``words`` is an array, or one string with blanks between the words, which comes
    to Python in a small part of the time. With ``key`` 'token' as
    :func:`encode_with_chars`: a known token whole, another by character. With
    'word' as :func:`with_ids`. ``vocab``, a bounded table of ``key`` and id, is
    broadcast. Documents without words give no row.
    """
    return docs.select("doc_id", "words").mapInArrow(_encoder(docs, vocab, key, unk), f"doc_id {_kind(docs)}, ids array<int>")


def encoded_sums(docs: DataFrame, vocab: DataFrame, key: str = "token", unk: int = 0) -> DataFrame:
    """doc_id, n, unknown, id_sum: number of ids, of ``unk`` and the sum of the ids of :func:`encode_documents`."""
    encode = _encoder(docs, vocab, key, unk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode(batches):
            ids, ends = batch.column("ids").flatten().to_numpy(), _ends(batch.column("ids"))
            sums = [np.concatenate([[0], x]).cumsum(dtype=np.int64)[ends] for x in (ids == unk, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.diff(x)) for x in (ends, *sums)]], ["doc_id", "n", "unknown", "id_sum"])

    return docs.select("doc_id", "words").mapInArrow(run, f"doc_id {_kind(docs)}, n long, unknown long, id_sum long")


def decode_documents(encoded: DataFrame, vocab: DataFrame, skip: list[int]) -> DataFrame:
    """doc_id, text as :func:`decode_tokens`, from (doc_id, ids); documents of ``skip`` ids only give no row."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(vocab, skip), f"doc_id {_kind(encoded)}, text string")


def recoded_documents(docs: DataFrame, vocab: DataFrame, skip: list[int], unk: int = 0) -> DataFrame:
    """:func:`decode_documents` of :func:`encode_documents`, whose ids do not leave Python."""
    encode, decode = _encoder(docs, vocab, "token", unk), _decoder(vocab, skip)
    return docs.select("doc_id", "words").mapInArrow(lambda batches: decode(encode(batches)), f"doc_id {_kind(docs)}, text string")


def decode_tokens(encoded: DataFrame, vocab: DataFrame, skip: list[int]) -> DataFrame:
    """doc_id, text: tokens of the ids in order, marker as blank, ``skip`` ids left out."""
    kept = encoded.filter(~F.col("id").isin(skip)) if skip else encoded
    named = kept.drop("token").join(vocab.select("token", "id"), "id", "left").withColumn("token", F.coalesce("token", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "token"))), lambda x: x["token"])
    text = F.trim(F.regexp_replace(F.array_join(parts, ""), MARKER, " "))
    return named.groupBy("doc_id").agg(text.alias("text"))


def unknown_rate(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """n_words, n_unknown, oov_rate (percent) and coverage (percent of the vocabulary that is used)."""
    counts = word_counts(words)
    hit = counts.join(vocab.select("word", F.lit(1).alias("known")), "word", "left")
    unknown = F.sum(F.when(F.col("known").isNull(), F.col("freq")).otherwise(0))
    sums = hit.agg(F.sum("freq").alias("n_words"), unknown.alias("n_unknown"), F.count("known").alias("used"))
    size = vocab.agg(F.count(F.lit(1)).alias("size"))
    rate = lambda a, b: 100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1))
    return sums.crossJoin(size).select("n_words", "n_unknown", rate("n_unknown", "n_words").alias("oov_rate"), rate("used", "size").alias("coverage"))  # one row each


def seen_and_unseen(train: DataFrame, test: DataFrame, n_seen: int, n_unseen: int, min_freq: int = 1) -> DataFrame:
    """word, freq, stratum, rank: the most frequent test words, by whether training words have them."""
    counts = word_counts(test).filter(F.col("freq") >= min_freq)
    known = train.select("word").distinct().withColumn("seen", F.lit(True))
    named = counts.join(known, "word", "left").withColumn("stratum", F.when(F.col("seen"), "seen").otherwise("oov"))
    order = W.partitionBy("stratum").orderBy(F.desc("freq"), "word")
    most = F.when(F.col("stratum") == "seen", n_seen).otherwise(n_unseen)
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(n_seen, n_unseen))
    return ranked.filter(F.col("rank") <= most).select("word", "freq", "stratum", "rank")


def sentence_chunks(words: DataFrame, size: int = 32, least: int = 3) -> DataFrame:
    """doc_id, chunk, words: runs of ``size`` words, those under ``least`` dropped."""
    chunk = F.floor(F.col("pos") / size).cast("int").alias("chunk")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return words.groupBy("doc_id", chunk).agg(ordered.alias("words")).filter(F.size("words") >= least)


def array_runs(words: Column, size: int) -> Column:
    """The parts of ``size`` of an array, each (chunk, words); none of an empty one."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at, i: F.struct(i.cast("int").alias("chunk"), F.slice(words, at + 1, F.lit(size)).alias("words")))


def document_chunks(docs: DataFrame, size: int = 32, least: int = 3) -> DataFrame:
    """doc_id, chunk, words as :func:`sentence_chunks`, of documents with an array ``words``: no row a word, no shuffle."""
    return docs.select("doc_id", F.inline(array_runs(F.col("words"), size))).filter(F.size("words") >= least)


def document_blocks(encoded: DataFrame, size: int) -> DataFrame:
    """doc_id, block, ids, targets: the blocks of :func:`token_blocks` as arrays, from (doc_id, ids).

    The targets are the ids one place on, one fewer in a document's last block.
    """
    starts = F.sequence(F.lit(0), F.size("ids") - 1, F.lit(size))
    part = lambda at: F.slice("ids", at, F.lit(size))
    blocks = F.transform(starts, lambda at, i: F.struct(i.cast("long").alias("block"), part(at + 1).alias("ids"), part(at + 2).alias("targets")))
    return encoded.filter(F.size("ids") > 0).select("doc_id", F.inline(blocks))


def token_blocks(stream: DataFrame, size: int) -> DataFrame:
    """``stream`` (doc_id, pos, id) with its block, offset and next token as target."""
    order = W.partitionBy("doc_id").orderBy("pos")
    return stream.select("*", F.floor(F.col("pos") / size).alias("block"), (F.col("pos") % size).alias("offset"), F.lead("id").over(order).alias("target"))


def word_features(segmented: DataFrame, words: DataFrame, roots: DataFrame, size: int = 32) -> DataFrame:
    """word, word_id, root_id, chars (ids, flags, len), labels, confidence of each distinct word of (word, segs).

    ``words`` and ``roots`` are ranked vocabularies; a test split passes those of
    the training split.
    """
    ids = lambda vocab, key, name: vocab.filter("id > 0").select(F.col("word").alias(key), F.col("id").alias(name))
    known = segmented.select("word", "segs", F.get("segs", F.lit(0)).alias("_root")).join(ids(words, "word", "word_id"), "word", "left").join(ids(roots, "_root", "root_id"), "_root", "left")
    cuts = S.labels(S.boundaries(F.col("segs")), size - 1)
    return known.select(
        "word", F.coalesce("word_id", F.lit(0)).alias("word_id"), F.coalesce("root_id", F.lit(0)).alias("root_id"), char_ids(F.col("word"), size).alias("chars"),
        cuts.alias("labels"), S.confidence(F.col("segs"), F.col("word")).alias("confidence"),
    )


def sentence_cache(words: DataFrame, features: DataFrame, size: int = 32, least: int = 3) -> DataFrame:
    """doc_id, chunk, sentence: runs of ``size`` words with their features, those under ``least`` dropped."""
    chunk = F.floor(F.col("pos") / size).cast("int").alias("chunk")
    rows = words.join(features, "word").groupBy("doc_id", chunk)
    fields = F.struct("pos", *features.columns)
    return rows.agg(F.array_sort(F.collect_list(fields)).alias("sentence")).filter(F.size("sentence") >= least)


def chunk_stats(chunks: DataFrame, root_length: int = 3, word_vocab: int = 0, root_vocab: int = 0) -> DataFrame:
    """n_sentences, n_words, words a sentence, characters and pieces a word of :func:`sentence_chunks`, in one row."""
    sums = chunks.select(F.size("words").alias("n"), F.aggregate("words", F.lit(0), lambda s, w: s + F.length(w)).alias("chars"), F.aggregate("words", F.lit(0), lambda s, w: s + F.ceil(F.length(w) / root_length).cast("int")).alias("pieces"))
    out = sums.agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_words"), F.sum("chars").alias("chars"), F.sum("pieces").alias("pieces"))
    mean = lambda a, b: (F.col(a) / F.greatest(b, F.lit(1))).cast("double")
    return out.select(
        "n_sentences", "n_words", mean("n_words", F.col("n_sentences")).alias("words_per_sentence"), mean("chars", F.col("n_words")).alias("word_length"),
        mean("pieces", F.col("n_words")).alias("pieces_per_word"), F.lit(word_vocab).cast("long").alias("word_vocab"), F.lit(root_vocab).cast("long").alias("root_vocab"),
    )


def segment_characters(segmented: DataFrame) -> DataFrame:
    """ch: the distinct characters of all pieces (column ``segs``)."""
    return segmented.select(F.explode("segs").alias("seg")).distinct().select(F.explode(characters(F.col("seg"))).alias("ch")).distinct()


def context_pairs(words: DataFrame, window: int = 2) -> DataFrame:
    """doc_id, word, context within ``window`` places: the in-row form of the band join."""
    grouped = words.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return pairs_of_arrays(grouped, window)


def pairs_of_arrays(df: DataFrame, window: int = 2, both: bool = True) -> DataFrame:
    """doc_id, word, context from doc_id and an array ``words``; no join and no shuffle.

    Without ``both`` only contexts after the word: a pair counts for both its words.
    """
    # One array of pairs a document: exploding the places would copy ``words`` to each.
    ahead = [d for d in range(1, window + 1)]
    pair = lambda a, b: F.struct(a.alias("word"), b.alias("context"))
    rest = lambda d: F.greatest(F.size("words") - d, F.lit(0))
    near = [F.zip_with(F.slice("words", F.lit(1), rest(d)), F.slice("words", F.lit(d + 1), rest(d)), pair) for d in ahead]
    forward = df.select("doc_id", F.inline(F.concat(*near)))
    if not both:
        return forward
    return forward.select("doc_id", F.inline(F.array(pair(F.col("word"), F.col("context")), pair(F.col("context"), F.col("word")))))


def negative_distribution(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """word, weight: freq ** power over its sum."""
    total = counts.agg(F.sum(F.pow("freq", F.lit(power))).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", (F.pow("freq", F.lit(power)) / F.col("total")).alias("weight"))  # one row


def root_splits(words: DataFrame, roots: DataFrame, suffixes: DataFrame, harden) -> DataFrame:
    """word, root_end: the longest root (itself or hardened) whose rest is empty or a suffix.

    Every split point is a row, and both parts are looked up by equi-joins.
    """
    size = F.length("word")
    points = words.select("word", F.explode(F.sequence(F.lit(1), size)).alias("at")).filter(size > 0)
    parts = points.select("word", "at", F.substring(F.col("word"), F.lit(1), F.col("at")).alias("root"), F.substring(F.col("word"), F.col("at") + 1, size).alias("suffix"))
    forms = parts.select("word", "at", "suffix", F.explode(F.array_distinct(F.array("root", harden(F.col("root"))))).alias("root"))
    rooted = forms.join(roots.select("root").distinct(), "root", "left_semi")
    ended = rooted.filter("suffix = ''").select("word", "at").unionByName(rooted.join(suffixes.select("suffix").distinct(), "suffix", "left_semi").select("word", "at"))
    return ended.groupBy("word").agg(F.max("at").alias("root_end"))


def lexicon(*columns: DataFrame) -> DataFrame:
    """Distinct entries of one-column frames, the union of word sources."""
    out = columns[0].toDF("word")
    for other in columns[1:]:
        out = out.union(other.toDF("word"))
    return out.distinct()


def first_columns(lines: DataFrame, lower) -> DataFrame:
    """Distinct first words of text lines, lower-cased: a lexicon file."""
    first = F.get(split_words(F.col("value")), F.lit(0))
    return lines.select(lower(first).alias("word")).filter("word is not null").distinct()


def vocab_stats(vocab: DataFrame, marker: str = MARKER) -> DataFrame:
    single = F.length("token") == 1
    special = F.col("token").isin(list(SPECIALS))
    starts: Column = F.col("token").startswith(marker)
    return vocab.agg(
        F.count(F.lit(1)).alias("size"), F.count_if(special).alias("specials"), F.count_if(single).alias("chars"),
        F.count_if(starts).alias("word_starts"), F.count_if(~single & ~special & ~starts).alias("inner"),
    )
