"""Text jobs over documents and pages."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import parsing as ps
from ..operators import analytics as an
from . import query

PLAIN = r"regexp_replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query("p28_plain_text", f"SELECT page_id, md5({PLAIN.format('html')}) AS text_hash, length({PLAIN.format('html')}) AS n_chars, left({PLAIN.format('html')}, 40) AS title FROM pages")
def _(t):
    text = ps.plain_text("html")
    return t.pages.select("page_id", text.alias("x")).select("page_id", F.md5("x").alias("text_hash"), F.length("x").cast("bigint").alias("n_chars"), ps.listing_title("x", keep=40).alias("title"))


EMAIL_RE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL = f"lower(regexp_extract({{0}}, '{EMAIL_RE}'))".replace("{2,}", "{{2,}}")
CONTACTS = "CASE WHEN contains({e}, 'http') OR contains({e}, 'qq.com') OR length({e}) <= 5 THEN '' ELSE {e} END AS email".replace("{e}", EMAIL.format("text")) + r""",
  coalesce(nullif(regexp_extract(text, '1[3-9]\d{9}'), ''), regexp_extract(text, '(?:\+86\s?)?0?\d{2,4}[)-]\d{7,8}')) AS phone,
  CASE WHEN length(trim(regexp_extract(text, '联系人[：:\s]*([^\s,，。\n]{2,10})', 1))) >= 2 THEN left(trim(regexp_extract(text, '联系人[：:\s]*([^\s,，。\n]{2,10})', 1)), 10) ELSE left(trim(regexp_extract(text, '经理[：:\s]*([^\s,，\n]{2,8})', 1)), 10) END AS contact"""


@query("p29_contacts", f"SELECT doc_id, {CONTACTS} FROM snippets", ("snippets",))
def _(t):
    return t.snippets.select("doc_id", ps.first_email("text").alias("email"), ps.first_phone("text").alias("phone"), ps.contact_name("text").alias("contact"))


@query("p29_contacts_folded", f"""SELECT source, coalesce(min_by(email, CASE WHEN email <> '' THEN doc_id END), '') AS email, coalesce(min_by(phone, CASE WHEN phone <> '' THEN doc_id END), '') AS phone, coalesce(min_by(contact, CASE WHEN contact <> '' THEN doc_id END), '') AS contact
  FROM (SELECT source, doc_id, {CONTACTS} FROM snippets) x GROUP BY source""", ("snippets",))
def _(t):
    return ps.fold_contacts(t.snippets, "source", "doc_id", "text")


WORDS = "|".join
QUALITY = rf"""q AS (SELECT doc_id, regexp_matches(text, '202[56]-\d{{2}}-\d{{2}}') AS has_when, regexp_matches(text, '{WORDS(fv.FACT_WORDS)}') AS has_what, regexp_matches(text, '{WORDS(fv.REASON_WORDS)}') AS has_why,
  regexp_matches(text, '[0-9a-f]{{7,40}}|\b\w+\.(py|sh|md|sql|json|yaml|yml|pyc)\b|`[/~][^`]+`|https?://|✅|❌|⚠️|🎉|\d+%|\d+\.\d+') AS has_witness, CASE WHEN age_days < 7 THEN 1.0e0 WHEN age_days < 30 THEN 0.7e0 ELSE 0.5e0 END AS freshness,
  CASE WHEN regexp_matches(text, '[0-9a-f]{{7,40}}') OR regexp_matches(text, '\d+%|测试 \d+/\d+') THEN 1.0e0 WHEN regexp_matches(text, '`[^`]+\.(py|sh|md|sql|json|yaml|yml)`') THEN 0.8e0 ELSE 0.7e0 END AS evidence FROM records),
s AS (SELECT doc_id, has_when, has_what, has_why, has_witness, floor((has_when::INT + has_what::INT + has_why::INT + has_witness::INT) / 4.0e0 * freshness * evidence * 1000.0e0 + 0.5e0 + 1e-9) / 1000.0e0 AS quality FROM q)"""
LEVEL = "CASE WHEN quality >= 0.8 THEN 'high' WHEN quality >= 0.5 THEN 'medium' ELSE 'low' END"


@query("p32_record_quality", f"WITH {QUALITY} SELECT *, {LEVEL} AS level FROM s", ("records",))
def _(t):
    return t.records.select("doc_id", ps.record_quality("text", F.col("age_days")).alias("q")).select("doc_id", "q.*")


@query("a26_quality_levels", f"WITH {QUALITY} SELECT {LEVEL} AS level, count(*) AS n FROM s GROUP BY ALL", ("records",))
def _(t):
    return t.records.select(ps.record_quality("text", F.col("age_days"))["level"].alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("a26_prospect_totals", f"SELECT count(*) AS total, count(CASE WHEN email <> '' THEN 1 END) AS with_email, count(CASE WHEN email = '' THEN 1 END) AS without_email FROM (SELECT {CONTACTS} FROM snippets) x", ("snippets",))
def _(t):
    return t.snippets.select(ps.first_email("text").alias("e")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("e") != "").alias("with_email"), F.count_if(F.col("e") == "").alias("without_email"))


@query("p33_log_bullets", r"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, regexp_replace(unnest(string_split(text, chr(10))), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM records),
  k AS (SELECT *, CASE WHEN regexp_matches(line, '^- \[x\]|^✅') THEN 'done' WHEN regexp_matches(line, '^\*\*.*决定') THEN 'decision' WHEN regexp_matches(line, '学到的教训|关键学习') THEN 'lesson' WHEN regexp_matches(line, '(?i)bug.*修复|修复.*bug') THEN 'bug' END AS kind FROM l)
  SELECT doc_id, line_no, kind, left(CASE WHEN kind = 'done' THEN regexp_replace(line, '^- \[x\] |^✅ ?', '') ELSE line END, 80) AS bullet FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 10""", ("records",))
def _(t):
    return ps.log_bullets(t.records, "doc_id", "text", top=10, keep=80).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("p33_log_headline", "SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN concat('Title ', cast(doc_id AS varchar)) END AS title FROM records WHERE doc_id % 5 = 3 OR NOT regexp_matches(text, '(?m)^#[ \\t]+\\S')", ("records",))
def _(t):
    title = ps.log_headline("text")
    return t.records.select("doc_id", title.alias("title")).where("title is null or title rlike '^Title [0-9]+$'")


STOP = ", ".join(f"'{w}'" for w in fv.INDEX_STOP_WORDS)
TOKENS = rf"""tokens AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{2,}}'), regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))) AS token FROM documents) x WHERE lower(token) NOT IN ({STOP}))"""


def tokens(t):
    return t.documents.select("doc_id", F.explode(ps.index_tokens("text")).alias("token"))


@query("p34_index_tokens", f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, min(token) AS first_token, max(token) AS last_token FROM tokens GROUP BY doc_id", ())
def _(t):
    return tokens(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("token").alias("first_token"), F.max("token").alias("last_token"))


@query("a25_inverted_index", f"WITH {TOKENS} SELECT token, count(*) AS n_docs FROM tokens GROUP BY token")
def _(t):
    return an.inverted_index(tokens(t), "doc_id")


@query("a25_document_entries", "SELECT doc_id, octet_length(encode(text)) AS size, left(md5(text), 8) AS hash FROM documents")
def _(t):
    return an.document_entries(t.documents, "doc_id", "text", ps.index_tokens("text")).select("doc_id", "size", "hash")


@query("u02_keep_first", r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) = 1)
  SELECT page_id, url, regexp_replace(title, '[^一-龥a-zA-Z0-9]', '', 'g') AS name_key FROM b QUALIFY row_number() OVER (PARTITION BY regexp_replace(title, '[^一-龥a-zA-Z0-9]', '', 'g') ORDER BY page_id) = 1""")
def _(t):
    pages = t.pages.select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    by_url = an.keep_first(pages, [F.regexp_replace("url", r"[?#].*$", "")], [F.col("page_id")])
    key = an.name_key(F.col("title"))
    return an.keep_first(by_url, [key], [F.col("page_id")]).select("page_id", "url", key.alias("name_key"))


@query("u03_index_difference", "SELECT doc_id, 'new' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels) UNION ALL SELECT doc_id * 2, 'removed' FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def _(t):
    return an.index_difference(t.documents, t.labels.select((F.col("doc_id") * 2).alias("doc_id")), "doc_id")


@query("u04_search_index", f"WITH {TOKENS} SELECT d.doc_id, octet_length(encode(text)) AS size FROM (SELECT DISTINCT doc_id FROM tokens WHERE contains(lower(token), 'thing')) h JOIN documents d ON d.doc_id = h.doc_id ORDER BY size DESC, d.doc_id LIMIT 10")
def _(t):
    sizes = t.documents.select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return an.search_index(tokens(t), sizes, "doc_id", "Thing")


@query("u05_excluded_words", "SELECT page_id, url FROM pages WHERE NOT (contains(url, 'ref=') OR contains(url, '#top')) AND length(url) >= 5")
def _(t):
    from ..functions.text import words_in

    return t.pages.where((F.size(words_in(F.col("url"), ["ref=", "#top"])) == 0) & (F.length("url") >= 5)).select("page_id", "url")
