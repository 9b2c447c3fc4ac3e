"""One query per operator, over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpointing import discard, materialize
from . import contamination, embeddings, flac, htmltext, infill, langid, linededup, minhash, packing, quality, resampling, sampling, warczip

#: Where the public tokenizers lie; their module gives the path of each file.
TOKENIZER = "byte_bpe_50k.json"
#: Portions of documents whose media are on the disk one after the other.
PORTIONS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of each whole text of ``documents``, sampled without replacement; each is
    decoded again and compared with its text."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = sampling.decode(sampling.sample_segmentations(docs, model, samples=2, carry=["doc_id", "text_crc32"]), model)
    return rows.select("doc_id", "sample", "n_pieces", F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion", (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("decodes"))


def op2_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of ``embeddings`` at a cosine of 0.98."""
    return embeddings.near_duplicate_embeddings(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as packaged WARC records and read back by ranges."""
    packages = materialize(warczip.write_packages(table(spark, sf_dir, "pages")), "packages")
    return warczip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` as FLAC streams, written down and decoded again by blocks.

    Documents go in ``PORTIONS`` portions, whose streams are removed once they are read back, so that not
    all of them lie on the disk at once."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("payload"))
    portion = F.pmod(F.xxhash64("doc_id", "payload"), F.lit(PORTIONS))
    docs = docs.withColumn("n_bytes", F.octet_length("payload").cast("long"))
    padded = F.greatest(F.lit(64), F.ceil(F.col("n_bytes") / 64) * 64).cast("int")
    full = F.concat("payload", F.substring(F.unhex(F.lit("00" * 64)), 1, padded - F.col("n_bytes").cast("int")))
    power = F.aggregate("blocks", F.lit(0).cast("long"), lambda total, x: total + x.energy)
    peak = F.array_max(F.transform("blocks", lambda x: x.peak))
    feature = F.format_string("blocks=%d;peak=%d;rms=%.4f", F.size("blocks"), peak, F.sqrt(power / F.octet_length("pcm")))
    out = None
    for k in range(PORTIONS):
        stored = materialize(flac.encode_column(docs.where(portion == k).withColumn("payload", full)).select("doc_id", "n_bytes", "media"), "media")
        rows = flac.decode_column(stored)
        rows = rows.select("doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pcm, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
        rows = materialize(rows, "features")
        discard(stored)
        out = rows if out is None else out.union(rows)
    return out


def op5_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into windows of 2048 tokens."""
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.assign(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of ``pages``."""
    return htmltext.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def train_quality(docs: DataFrame, labels: DataFrame):
    """Word vectors from all documents and a network from the labels of the training folds."""
    return quality.train(docs, labels.where(fold("doc_id", 5) != 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of ``documents``, learnt from ``labels`` of four folds out of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors, net = train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, vectors, net)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that three documents or more share."""
    out = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def train_languages(docs: DataFrame):
    """Profiles from the documents of two folds out of three."""
    return langid.train_profiles(docs.where(fold("doc_id", 3) != 1))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learnt from two folds out of three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), train_languages(docs))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` stored as seekable frames, cut and rearranged for fill-in-middle, and
    rebuilt from the rearranged text."""
    stored = materialize(infill.store(table(spark, sf_dir, "documents").select("doc_id", "text")), "frames")
    rows = infill.restore(infill.transform(infill.plan_cuts(stored)), text=None)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside passages of ``benchmark`` of ten words, or whole shorter items."""
    return contamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` drawn towards the word distribution of ``benchmark``."""
    rows = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_gumbel_segmentations": op1_gumbel_segmentations,
    "op3_warc_zip": op3_warc_zip,
    "op4_flac": op4_flac,
    "op7_html_text": op7_html_text,
    "op2_hyperplane_dedup": op2_hyperplane_dedup,
    "op5_minhash_join": op5_minhash_join,
    "op6_bin_slack_packing": op6_bin_slack_packing,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_infill": op11_infill,
    "op12_decontamination": op12_decontamination,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = {
    "op3_warc_zip": r"""
        with page as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        first as (select payload_digest, max(page_id) as keeper from page where payload_bytes >= 1000 group by payload_digest)
        select page_id, payload_bytes, payload_digest,
               case when keeper is not null and keeper <> page_id and payload_bytes >= 1000 then 'revisit' else 'response' end as record_type,
               case when keeper is not null and keeper <> page_id and payload_bytes >= 1000 then keeper end as refers_to
        from page left join first using (payload_digest)""",
    "op9_line_dedup": r"""
        with doc as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
        line as (select r, doc_id, unnest(parts) as line, unnest(range(1, len(parts) + 1)) as pos from doc),
        keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
        often as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct r) >= 3),
        marked as (select k.*, o.key is not null and k.doc_id is distinct from o.keeper as gone from keyed k left join often o using (key))
        select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from marked group by r, doc_id""",
    "op2_hyperplane_dedup": r"""
        with recursive good as (
            select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
                 where list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
        comp as (select a as vec_id, min(b) as component_id from reach group by a),
        n as (select a as vec_id, count(*) as n from link group by a)
        select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
        from embeddings e join comp c using (vec_id) left join n using (vec_id)""",
    "op5_minhash_join": r"""
        with recursive word as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        sets as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                   else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as s from word),
        size as (select doc_id, count(*) as n from sets group by doc_id),
        share as (select a.doc_id as a, b.doc_id as b, count(*) as common from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        half as (select a, b from share join size x on x.doc_id = a join size y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
        link as (select a, b from half union all select b, a from half),
        reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join link l on r.b = l.a),
        comp as (select a as doc_id, min(b) as component_id from reach group by a)
        select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
        from documents d join comp c using (doc_id) left join size z using (doc_id)""",
    "op11_infill": r"""
        with doc as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
        unit as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u, list_transform(range(4), lambda k: ('0x' || d[8 * k + 1 : 8 * k + 8])::bigint) as h from doc),
        cut as (select *, len(u)::bigint as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as hi,
                  case when text = '' or regexp_matches(text, '<[PSM]>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from unit),
        part as (select *, coalesce(array_to_string(u[1 : lo], ''), '') as p, coalesce(array_to_string(u[lo + 1 : hi], ''), '') as m, coalesce(array_to_string(u[hi + 1 :], ''), '') as s from cut)
        select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(text) as restored_sha256
        from part""",
    "op12_decontamination": r"""
        with doc as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        item as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select distinct item, least(len(w), 10) as n, array_to_string(w[i + 1 : i + 10], ' ') as t from (select item, w, unnest(range(greatest(len(w) - 9, 1))) as i from item where len(w) > 0)),
        size as (select distinct n from win),
        gram as (select r, i, n, array_to_string(w[i + 1 : i + n], ' ') as t from (select r, w, n, unnest(range(len(w) - n + 1)) as i from doc, size where len(w) >= n)),
        hit as (select r, i, n, item from gram join win using (n, t)),
        word as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from (select distinct r, i, n from hit)) group by r),
        named as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct r, item from hit) group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
        from doc left join word using (r) left join named using (r)""",
    "op13_importance_resampling": r"""
        with recursive step(k, i, x) as (select 0, i, i from range(256) b(i) union all select k + 1, i, case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end from step where k < 8),
        tab as (select list(x order by i) as t from step where k = 8),
        doc as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        item as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        f as (select r, unnest(w) as g from doc), fb as (select unnest(w) as g from item),
        vocab as (select distinct g from (select g from f union all select g from fb)),
        bucket as (select g, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(g))), lambda k: ('0x' || hex(encode(g))[2 * k + 1 : 2 * k + 2])::bigint)),
                     lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 10000 as b from vocab, tab),
        s as (select b, count(*) as n from f join bucket using (g) group by b), t as (select b, count(*) as n from fb join bucket using (g) group by b),
        total as (select coalesce((select sum(n) from s), 0)::double as ss, coalesce((select sum(n) from t), 0)::double as tt),
        gain as (select k.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (ss + 10000) / ((coalesce(s.n, 0) + 1)::double * (tt + 10000))))::bigint as g from range(10000) k(b) left join s on s.b = k.b left join t on t.b = k.b, total),
        w as (select r, sum(gain.g)::bigint as weight from f join bucket using (g) join gain using (b) group by r),
        scored as (select r, doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
                     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5) / 4294967296.0)))::bigint as score from doc left join w using (r)),
        able as (select r, row_number() over (order by score desc, doc_id nulls last) as k, count(*) over () as n from scored where n_features >= 20)
        select doc_id, n_features, weight::bigint as weight, score::bigint as score, case when k <= floor(10 * n / 100) then k end as rank from scored left join able using (r)""",
}
