"""Corpus building: transcripts to utterances, frames, splits, vocabularies and token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions import text as X

from .util import draw, global_index


def stem(c: str | Column) -> Column:
    return F.regexp_replace(X.col(c), r"\.[^.]*$", "")


def valid_transcripts(df: DataFrame) -> DataFrame:
    """Rows of files with over one row and one video name, which holds no 'part' and has the transcript's stem."""
    good = df.groupBy("transcript_filename").agg(F.count("*").alias("n"), F.count_distinct("video_name").alias("v"), F.max("video_name").alias("video"))
    good = good.where((F.col("n") > 1) & (F.col("v") == 1) & ~F.col("video").contains("part") & (stem("video") == stem("transcript_filename")))
    return df.join(good.select("transcript_filename"), "transcript_filename", "left_semi")


def add_end_time(df: DataFrame) -> DataFrame:
    """Start and end seconds; the end is the next row's start in file order, and its own start for the last row."""
    w = Window.partitionBy("transcript_filename").orderBy("row_idx")
    start = X.parse_timestamp("time_raw")
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn("start", start).withColumn("end", F.when(last, F.col("start")).otherwise(F.lead("start").over(w)))


def filter_speakers(df: DataFrame, allowed: list[str] = X.SPEAKERS) -> DataFrame:
    """Rows of allowed speakers with both times, in order (rows that end before they start are left out)."""
    return df.where(F.col("speaker").isin(allowed) & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end")))


def interpolate_sentences(df: DataFrame) -> DataFrame:
    """C4: one row a sentence, with n + 1 even time points between start and end, cut to whole seconds."""
    cut = df.withColumn("sentences", X.split_sentences(X.strip_annotations("utterance"))).withColumn("n", F.size("sentences"))
    rows = cut.select("*", F.posexplode("sentences").alias("i", "sentence"))
    at = lambda i: (F.col("start") + (F.col("end") - F.col("start")) * i / F.col("n")).cast("int")
    return rows.select("transcript_filename", "video_name", "row_idx", "i", "sentence", at(F.col("i")).alias("s_start"), at(F.col("i") + 1).alias("s_end"))


def number_utterances(df: DataFrame) -> DataFrame:
    """Utterance numbers from 1 within a transcript."""
    w = Window.partitionBy("transcript_filename").orderBy("row_idx", "i")
    return df.withColumn("utterance_num", F.row_number().over(w))


def explode_frames(df: DataFrame, fps: int = 5, max_frames: int = 32) -> DataFrame:
    """Frames of a sentence, fps a second, 1 to max_frames, with their times and file names."""
    n = F.least(F.greatest(((F.col("s_end") - F.col("s_start")) * fps).cast("int"), F.lit(1)), F.lit(max_frames))
    rows = df.withColumn("frame_num", F.explode(F.sequence(F.lit(0), n - 1)))
    name = F.concat(stem("transcript_filename"), F.lit("_"), F.format_string("%03d_%02d", "utterance_num", "frame_num"), F.lit(".jpg"))
    return rows.select("transcript_filename", F.col("video_name").alias("video_filename"), F.col("sentence").alias("utterance"), (F.col("s_start") + F.col("frame_num") / fps).alias("timestamp"), "utterance_num", "frame_num", name.alias("frame_filename"))


def preprocess(df: DataFrame, allowed: list[str] = X.SPEAKERS) -> DataFrame:
    """C1-C6 in one: frame rows of transcripts."""
    return explode_frames(number_utterances(interpolate_sentences(filter_speakers(add_end_time(valid_transcripts(df)), allowed))))


def group_utterances(df: DataFrame) -> DataFrame:
    """One row an utterance, timestamps in row order and file names sorted; rows without text are left out."""
    rows = df.where("utterance is not null").groupBy("transcript_filename", "video_filename", "utterance_num")
    return rows.agg(F.min_by("utterance", "frame_num").alias("utterance"), F.count("*").cast("int").alias("num_frames"), F.transform(F.sort_array(F.collect_list(F.struct("frame_num", "timestamp"))), lambda x: x["timestamp"]).alias("timestamps"), F.sort_array(F.collect_list("frame_filename")).alias("frame_filenames"))


def filter_existing_frames(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """Utterances with the frames that the inventory (frame_filename) has; without any they go. num_frames and timestamps stay."""
    key = ["transcript_filename", "utterance_num"]
    kept = df.select(*key, F.explode("frame_filenames").alias("frame_filename")).join(inventory.select("frame_filename").distinct(), "frame_filename", "left_semi")
    return df.drop("frame_filenames").join(kept.groupBy(*key).agg(F.sort_array(F.collect_list("frame_filename")).alias("frame_filenames")), key)


def split_dataset(df: DataFrame, *key: str, train: float = 0.9, val: float = 0.05, seed: int = 0) -> DataFrame:
    """Split train, val or test, with exact counts int(n * share), in an order drawn by seed and key."""
    ordered = global_index(df.withColumn("__d", draw(seed, *key)), F.col("__d"), *[F.col(k) for k in key], name="__i")
    n = ordered.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    return ordered.withColumn("split", F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "val").otherwise("test")).drop("__d", "__i")


def random_split(df: DataFrame, fraction: float, *key: str, seed: int = 0) -> DataFrame:
    """first = True for int(n * fraction) rows drawn by seed and key."""
    ordered = global_index(df.withColumn("__d", draw(seed, *key)), F.col("__d"), *[F.col(k) for k in key], name="__i")
    return ordered.withColumn("first", F.col("__i") < int(ordered.count() * fraction)).drop("__d", "__i")


def split_per_category(df: DataFrame, category: str, *key: str, fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """C11: dev or test within each category, int(n * fraction) to dev."""
    placed = global_index(df.withColumn("__d", draw(seed, *key)), F.col(category), F.col("__d"), *[F.col(k) for k in key], name="__i")  # a category is a range of places
    ranges = placed.groupBy(F.col(category).alias("__c")).agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    j = placed.join(ranges, placed[category].eqNullSafe(ranges["__c"]))
    return j.withColumn("split", F.when(F.col("__i") - F.col("__first") < F.floor(F.col("__n") * fraction), "dev").otherwise("test")).drop("__d", "__i", "__c", "__first", "__n")


def shuffle_pairs(df: DataFrame, text: str, *key: str, seed: int = 0) -> DataFrame:
    """The texts of all rows dealt out again by a drawn order."""
    keys = [F.col(k) for k in key]
    places = global_index(df.drop(text), *keys, name="__i")
    drawn = global_index(df.select(text, *key, draw(seed, *key).alias("__d")), F.col("__d"), *keys, name="__i").select("__i", text)
    return places.join(drawn, "__i").drop("__i")


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def build_vocab(df: DataFrame, tokens: Column, min_freq: int = 3) -> DataFrame:
    """Token, token_id, freq of tokens seen min_freq times, most frequent first, after four special tokens."""
    kept = token_counts(df, tokens).where(F.col("freq") >= min_freq)
    return global_index(kept, F.desc("freq"), F.asc("token"), name="token_id").select("token", (F.col("token_id") + len(X.SPECIAL_TOKENS)).alias("token_id"), "freq")


def build_caption_vocab(df: DataFrame, tokens: Column, threshold: int = 5) -> DataFrame:
    """C14: tokens seen more than threshold times; ties in reverse token order."""
    kept = token_counts(df, tokens).where(F.col("freq") > threshold)
    return global_index(kept, F.desc("freq"), F.desc("token"), name="token_id").select("token", (F.col("token_id") + len(X.SPECIAL_TOKENS)).alias("token_id"), "freq")


def caption_stats(df: DataFrame, tokens: Column, threshold: int = 5) -> DataFrame:
    """C14: total tokens, types, types outside the vocabulary, share of unknown tokens, longest caption."""
    counts = token_counts(df, tokens)
    low = F.col("freq") <= threshold
    a = counts.agg(F.sum("freq").alias("total_tokens"), F.count("*").alias("types"), F.sum(low.cast("long")).alias("oov_types"), F.sum(F.when(low, F.col("freq")).otherwise(0)).alias("oov_tokens"))
    b = df.agg(F.max(F.size(tokens)).alias("max_length"))
    return a.crossJoin(b).select("total_tokens", "types", "oov_types", (F.col("oov_tokens") / F.col("total_tokens")).alias("unk_rate"), "max_length")


def build_event_vocab(df: DataFrame, tokens: Column, max_size: int = 30000, min_freq: int = 1) -> DataFrame:
    """The max_size - 4 most frequent tokens; ties in token order."""
    kept = token_counts(df, tokens).where(F.col("freq") >= min_freq).orderBy(F.desc("freq"), "token").limit(max_size - 4)
    return global_index(kept, F.desc("freq"), F.asc("token"), name="token_id").select("token", (F.col("token_id") + 4).alias("token_id"), "freq")


def encode_tokens(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, policy: str = "raw", max_len: int = 25) -> DataFrame:
    """Key, token_ids, length. <sos> ids <eos>, unknown = 1. raw: all; cut: max_len ids at most; fixed: max_len - 2 words, padded."""
    words = df.select(key, tokens.alias("ws"))
    if policy == "fixed":
        words = words.withColumn("ws", F.slice("ws", 1, max_len - 2))
    pairs = words.select(key, F.posexplode_outer("ws").alias("i", "token")).join(vocab.select("token", "token_id"), "token", "left")
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.coalesce("token_id", F.lit(1)).alias("id"))))), lambda x: x["id"].cast("int"))
    out = pairs.groupBy(key).agg(F.concat(F.array(F.lit(2)), ids, F.array(F.lit(3))).alias("token_ids"))
    if policy == "cut":
        out = out.withColumn("token_ids", F.slice("token_ids", 1, max_len))
    out = out.withColumn("length", F.size("token_ids"))
    if policy == "fixed":
        out = out.withColumn("token_ids", F.concat("token_ids", F.array_repeat(F.lit(0), F.lit(max_len) - F.size("token_ids"))))
    return out


def decode_tokens(df: DataFrame, key: str, vocab: DataFrame, ignore: list[int] = (0, 2, 3)) -> DataFrame:
    """C17: key and the words of token_ids (first length ids) without ignored ids."""
    ids = df.select(key, F.posexplode_outer(F.slice("token_ids", F.lit(1), F.col("length"))).alias("i", "token_id")).where(F.col("token_id").isNull() | ~F.col("token_id").isin(list(ignore)))
    words = ids.join(vocab.select("token", F.col("token_id").cast("int").alias("token_id")), "token_id", "left").withColumn("token", F.when(F.col("token_id") == 1, "<unk>").otherwise(F.col("token")))
    return words.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "token")))), lambda x: x["token"]).alias("words"))


def decode_sentences(df: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """C17: key and the sentence of token_ids: what stands before the first pad (0), without a last <eos> (3) and then a first <sos> (2)."""
    ids = F.col("token_ids")
    pad = F.array_position(ids, F.lit(0).cast("int"))
    own = F.when(pad > 0, F.slice(ids, F.lit(1), (pad - 1).cast("int"))).otherwise(ids)
    own = F.when(F.try_element_at(own, F.lit(-1)) == 3, F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)
    own = F.when(F.get(own, F.lit(0)) == 2, F.slice(own, F.lit(2), F.size(own))).otherwise(own)
    marks = F.create_map(*[F.lit(x) for kv in {1: "<unk>", 2: "<sos>", 3: "<eos>"}.items() for x in kv])
    each = df.select(key, F.posexplode_outer(own).alias("i", "token_id")).join(vocab.select("token", F.col("token_id").cast("int").alias("token_id")), "token_id", "left")
    word = each.withColumn("token", F.coalesce(F.try_element_at(marks, "token_id"), F.col("token")))
    return word.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "token")))), lambda x: x["token"]), " ").alias("sentence"))


def sample_bag(df: DataFrame, key: str, frames: str, m: int = 5, contiguous: bool = True, seed: int = 0) -> DataFrame:
    """M frames of the array column: a run from a drawn start, or the m least draws; with fewer than m, m draws with replacement. Sorted by place."""
    n = F.size(frames)
    start = F.pmod(draw(seed, key), F.greatest(n - m + 1, F.lit(1)))
    run = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: (start + i).cast("int"))
    by = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    least = F.array_sort(F.transform(F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(by(i).alias("d"), i.alias("i")))), 1, m), lambda x: x["i"]))
    again = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.pmod(by(i), F.greatest(n, F.lit(1))).cast("int")))
    places = F.when(n >= m, run if contiguous else least).otherwise(again)
    return df.where(n > 0).withColumn("bag", F.transform(places, lambda i: F.get(F.col(frames), i)))


def sample_frame(df: DataFrame, key: str, frames: str, multiple: bool = False, seed: int = 0) -> DataFrame:
    """One frame of each row: the first, or a drawn one."""
    at = F.pmod(draw(seed, key), F.greatest(F.size(frames), F.lit(1))).cast("int") if multiple else F.lit(0)
    return df.withColumn("frame", F.get(F.col(frames), at))


def pair_events(utts: DataFrame, frames: DataFrame, fps: float = 5.0) -> DataFrame:
    """Utterances (event, u, us, ue, es) with the frames (event, idx from 0) from floor((us-es)*fps) to ceil((ue-es)*fps), both in range.

    A slice is computed from the event's number of frames and exploded, so nothing is joined that isn't returned; further columns
    of frames come by (event, idx), which spreads a long event. All frames where a time is missing; events without frames have no rows.
    """
    last = F.col("n_frames") - 1
    place = lambda t, up: up(F.greatest((F.col(t) - F.col("es")) * fps, F.lit(0.0)))
    s, e = place("us", F.floor), place("ue", F.ceil)
    whole = F.col("us").isNull() | F.col("ue").isNull() | F.col("es").isNull()
    cut = F.sequence(F.least(s, last), F.least(F.greatest(s, e), last))
    sized = utts.join(frames.groupBy("event").agg(F.count("*").alias("n_frames")), "event")
    pairs = sized.select("event", "u", F.explode(F.when(whole, F.sequence(F.lit(0).cast("long"), last)).otherwise(cut)).alias("idx"))
    more = [c for c in frames.columns if c not in ("event", "idx", "n_frames")]
    return pairs.join(frames.select("event", "idx", *more), ["event", "idx"]).select("event", "u", "idx", *more) if more else pairs


def pair_sentences(events: DataFrame, frames: DataFrame, text: str = "narration", max_global: int = 4) -> DataFrame:
    """Event, u (place from 0), sentence and idx: the first max_global sentences of an event's text, each with all of its frames."""
    said = F.slice(X.whole_sentences(text), 1, max_global)
    each = events.select("event", F.posexplode(said).alias("u", "sentence"))
    sized = each.join(frames.groupBy("event").agg(F.count("*").alias("n_frames")), "event")
    return sized.select("event", "u", "sentence", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("idx"))


def resolve_event_frames(events: DataFrame, own: DataFrame, video: DataFrame, fps: float = 5.0) -> DataFrame:
    """Frames of an event: its own (event, idx, frame), else its video's (video, idx, frame) from floor(start*fps) to ceil(end*fps)-1, in range."""
    mine = events.join(own, "event").select("event", "idx", "frame")
    rest = events.join(own.select("event").distinct(), "event", "left_anti").join(video, "video")
    cut = rest.where((F.col("idx") >= F.floor(F.greatest(F.col("start"), F.lit(0.0)) * fps)) & (F.col("idx") <= F.greatest(F.ceil(F.col("end") * fps) - 1, F.floor(F.col("start") * fps))))
    return mine.unionByName(cut.select("event", "idx", "frame"))


def caption_mismatches(annotations: DataFrame, sentences: DataFrame) -> DataFrame:
    """(image_id, sent_id) whose caption and raw sentence differ, or that one side lacks."""
    j = annotations.join(sentences, ["image_id", "sent_id"], "full")
    return j.where(~F.col("caption").eqNullSafe(F.col("raw"))).select("image_id", "sent_id")


def caption_splits(df: DataFrame) -> DataFrame:
    """Distinct (split, source split), with restval as train."""
    return df.select(F.when(F.col("split") == "restval", "train").otherwise(F.col("split")).alias("split"), F.col("split").alias("source_split")).distinct()


def caption_integrity(annotations: DataFrame, images: DataFrame, sentences: DataFrame, source_images: DataFrame) -> DataFrame:
    """sent_id and reason of annotations (sent_id, image_id, caption) that don't agree with the source they stand beside.

    images: id, file_name; sentences: sent_id, imgid, raw; source_images: imgid, cocoid, filename. Reasons, the first that holds:
    image (none of that id), sentence (none), caption (another text), source (no source image), image_id, file_name (the last
    sixteen characters of the source's differ).
    """
    j = annotations.join(images.select(F.col("id").alias("image_id"), F.col("file_name"), F.lit(True).alias("has_image")), "image_id", "left")
    j = j.join(sentences.select("sent_id", "imgid", "raw", F.lit(True).alias("has_sentence")), "sent_id", "left").join(source_images.select("imgid", "cocoid", "filename", F.lit(True).alias("has_source")), "imgid", "left")
    reason = F.when(F.col("has_image").isNull(), "image").when(F.col("has_sentence").isNull(), "sentence").when(~F.col("raw").eqNullSafe(F.col("caption")), "caption").when(F.col("has_source").isNull(), "source")
    reason = reason.when(~F.col("cocoid").eqNullSafe(F.col("image_id")), "image_id").when(~F.right("filename", F.lit(16)).eqNullSafe(F.col("file_name")), "file_name")
    return j.withColumn("reason", reason).where("reason is not null").select("sent_id", "reason")
