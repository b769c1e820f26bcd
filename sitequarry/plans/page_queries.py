"""URLs, classification, ranking, sections and documents over the crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions import urls
from sitequarry.functions.text import first_sentences, hash_content, word_count
from sitequarry.operators import document, validate
from sitequarry.operators.pages import highlights, rank, scored
from sitequarry.operators.sections import sections
from sitequarry.plans.views import LINKED, PAGES_SQL, RANKED, SCORE_SQL, entries, label_sql, pages
from sitequarry.sources.tables import materialize, table


def url_normalize(spark: SparkSession, root: str) -> DataFrame:
    return pages(spark, root, []).select("seq", "site_id", "url")


def url_parts(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, root, []).select("seq", urls.host(u).alias("host"), urls.path(u).alias("path"), F.size(urls.segments(u)).cast("long").alias("n_segments"), urls.base_path(u).alias("base_path"), urls.is_likely_page(u).alias("likely"), urls.title_from_path(u).alias("path_title"))


def same_site(spark: SparkSession, root: str) -> DataFrame:
    """Pages by site that lie on the site's host, and in its entry's directory."""
    both = pages(spark, root, []).select("site_id", "url").join(entries(spark, root), "site_id")
    here, inside = urls.is_same_site(F.col("url"), F.col("entry_url")), urls.in_scope(F.col("url"), F.col("entry_url"), F.lit(True))
    return both.groupBy("site_id").agg(F.count("*").alias("pages"), F.count_if(here).alias("same_site"), F.count_if(inside).alias("in_scope"))


def resolve_links(spark: SparkSession, root: str) -> DataFrame:
    """Targets of relative references and of Link headers, on the pages' own urls."""
    base = pages(spark, root, []).select("seq", "url")
    header = F.concat(F.lit('<https://cdn.example/a.css>; rel=preload, <mailto:a@b.example>; rel="alternate"; type="text/markdown", <../md/'), F.col("seq").cast("string"), F.lit('.md?utm_a=1>; rel="alternate"; type="text/markdown"'))
    rows = base.select("seq", "url", F.lit("../up/./x/?b=2&a=1#f").alias("reference"), urls.markdown_targets(header).alias("targets"))
    return rows.select("seq", urls.resolve_url("reference", "url").alias("resolved"), urls.resolve_first("targets", "url").alias("markdown"))


def classify_pages(spark: SparkSession, root: str) -> DataFrame:
    return pages(spark, root, []).select("seq", "path", "kind")


def score_pages(spark: SparkSession, root: str) -> DataFrame:
    return scored(pages(spark, root, RANKED)).select("seq", F.round("score", 6).alias("score"))


def rank_pages(spark: SparkSession, root: str) -> DataFrame:
    """The 50 best pages of each site: a top-k report."""
    return rank(pages(spark, root, RANKED), 50).select("site_id", "seq", "url", "kind", F.round("score", 6).alias("score"), "rank")


def top_highlights(spark: SparkSession, root: str) -> DataFrame:
    return highlights(pages(spark, root, RANKED), 5).select("site_id", "seq", "rank")


def site_sections(spark: SparkSession, root: str) -> DataFrame:
    return sections(pages(spark, root), entries(spark, root))


def section_budget(spark: SparkSession, root: str) -> DataFrame:
    """Sections under budgets small enough to bind in every larger site."""
    return sections(pages(spark, root), entries(spark, root), 3, 12)


def site_profiles(spark: SparkSession, root: str) -> DataFrame:
    return document.profiles(pages(spark, root, [*LINKED, "lead"]), entries(spark, root))


def render_index(spark: SparkSession, root: str) -> DataFrame:
    rows = materialize(pages(spark, root, [*LINKED, "lead"]))
    return document.render(document.documents(rows, entries(spark, root)))


def render_full(spark: SparkSession, root: str) -> DataFrame:
    """Parts of the full files: the index and every page's text."""
    return document.render_full(render_index(spark, root), pages(spark, root, ["title", "text"]))


def validate_rendered(spark: SparkSession, root: str) -> DataFrame:
    """The rendered files, validated: errors can only come from closing brackets in urls."""
    return validate.verdicts(render_index(spark, root), "site_id", "llms_txt").select("site_id", "valid", "errors", "sections", "links")


def text_functions(spark: SparkSession, root: str) -> DataFrame:
    text = F.col("text")
    return table(spark, root, "documents").select("doc_id", word_count(text).cast("long").alias("words"), first_sentences(text, 180).alias("lead"), hash_content(F.coalesce("title", F.lit("")), F.lit(""), text).alias("content_hash"))


_LINKS = r"""
, sc AS (SELECT pg.*, __SCORE__ score, coalesce(markdown_url, url) target FROM pg),
lc AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.site_id, target ORDER BY score DESC, seq) rn FROM sc LEFT JOIN en USING (site_id)
  WHERE coalesce(url <> entry_url AND target <> entry_url, true)) WHERE rn = 1),
bk AS (SELECT *, CASE kind WHEN 'home' THEN 'Overview' WHEN 'docs' THEN 'Documentation' WHEN 'api' THEN 'API Reference' WHEN 'guide' THEN 'Guides & Tutorials' WHEN 'product' THEN 'Product'
  WHEN 'company' THEN 'Company' WHEN 'support' THEN 'Support' WHEN 'blog' THEN 'Blog & Updates' WHEN 'legal' THEN 'Optional' ELSE
  __LABEL__ END bucket FROM (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '')[1] first FROM lc)),
fx AS (SELECT unnest(['Overview', 'Documentation', 'API Reference', 'Guides & Tutorials', 'Product', 'Company', 'Support', 'Blog & Updates', 'Other Pages', 'Optional']) nm, unnest(range(10)) ix),
fo AS (SELECT *, count(*) OVER (PARTITION BY site_id, bucket) = 1 AND bucket NOT IN (SELECT nm FROM fx) folded FROM bk),
se AS (SELECT *, CASE WHEN folded THEN 'Other Pages' ELSE bucket END section FROM fo),
rk AS (SELECT se.*, row_number() OVER (PARTITION BY site_id, section ORDER BY folded, score DESC, seq) r, coalesce(ix, 8) ix, section = 'Other Pages' oth FROM se LEFT JOIN fx ON section = nm),
kp AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ix, oth, lower(section), section, r) no FROM rk WHERE section <> 'Optional' AND r <= __S__),
ch AS (SELECT * FROM kp WHERE no <= __F__),
fe AS (SELECT site_id, seq, url, target, title, description, score, 0 a, ix, oth, section sn, 0 c, r FROM rk WHERE section = 'Optional'
  UNION ALL SELECT site_id, seq, url, target, title, description, score, 1, ix, oth, section, 0, r FROM rk WHERE section <> 'Optional' AND r > __S__
  UNION ALL SELECT site_id, seq, url, target, title, description, score, 1, ix, oth, section, 1, r FROM kp WHERE no > __F__),
us AS (SELECT site_id, count(*) used FROM ch GROUP BY site_id),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, a, ix, oth, lower(sn), sn, c, r) no FROM fe) LEFT JOIN us USING (site_id) WHERE no <= __S__ AND no <= __F__ - coalesce(used, 0)),
al AS (SELECT site_id, ix, oth, lower(section) l, section, r, title, target, description FROM ch UNION ALL SELECT site_id, 99, true, '', 'Optional', no, title, target, description FROM la),
li AS (SELECT site_id, dense_rank() OVER (PARTITION BY site_id ORDER BY ix, oth, l, section) section_pos, section, row_number() OVER (PARTITION BY site_id, ix, oth, l, section ORDER BY r) link_pos, title, target url, nullif(description, '') notes FROM al)
""".replace("__SCORE__", SCORE_SQL).replace("__LABEL__", f"CASE WHEN coalesce(first, '') = '' THEN 'Other Pages' ELSE {label_sql('first')} END")


def _links_sql(per_section: int, per_file: int) -> str:
    return PAGES_SQL + _LINKS.replace("__S__", str(per_section)).replace("__F__", str(per_file))


_WS_OF = r"trim(regexp_replace(__X__, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))"


def _ws(text: str) -> str:
    return _WS_OF.replace("__X__", text)


def _lead_sql(text: str, most: int) -> str:
    n = _ws(text)
    cut = f"substr({n}, 1, {most})"
    spot = lambda m: f"CASE WHEN strpos(reverse({cut}), '{m}') > 0 THEN length({cut}) - strpos(reverse({cut}), '{m}') - 1 ELSE -1 END"
    at = f"greatest({spot(' .')}, {spot(' ?')})"
    return f"CASE WHEN length({n}) <= {most} THEN {n} ELSE trim(CASE WHEN {at} > 60 THEN substr({cut}, 1, {at}) ELSE {cut} END) || '…' END"


_HEADS = (
    r"""
, ep AS (SELECT * FROM (SELECT pg.site_id, title, description, text, row_number() OVER (PARTITION BY pg.site_id ORDER BY url <> entry_url, seq) rn FROM pg JOIN en USING (site_id)) WHERE rn = 1),
hd AS (SELECT en.site_id, entry_url base_url, substr(__NAME__, 1, 80) AS name, coalesce(nullif(ep.description, ''), ep.text, '') src FROM en LEFT JOIN ep USING (site_id)),
pr AS (SELECT site_id, base_url, name, __LEAD__ summary FROM hd)
"""
).replace("__NAME__", _ws("site_name")).replace("__LEAD__", _lead_sql("src", 260))

_SAFE = r"regexp_replace({}, '^([#>\-*])', '\\\1')"
_RENDER = r"""
, dc AS (SELECT pr.site_id, name, summary, section_pos, section, link_pos, url, CASE WHEN notes <> summary THEN notes END notes,
  CASE WHEN length(name) > 0 AND lower(rtrim(title)) LIKE '%' || lower(name) AND regexp_matches(substr(title, 1, length(rtrim(title)) - length(name)), '[|\-–—\\/·:]\s*$')
    AND trim(regexp_replace(substr(title, 1, length(rtrim(title)) - length(name)), '\s*[|\-–—\\/·:]\s*$', '')) <> '' THEN trim(regexp_replace(substr(title, 1, length(rtrim(title)) - length(name)), '\s*[|\-–—\\/·:]\s*$', '')) ELSE title END lt
  FROM pr LEFT JOIN li USING (site_id)),
ln AS (SELECT *, CASE WHEN link_pos = 1 THEN E'\n\n## ' || section || E'\n\n' ELSE E'\n' END || '- [' || translate(__LT__, '[]', '') || '](' || replace(url, '%', '%25') || ')' || coalesce(': ' || __NT__, '') line FROM dc)
SELECT site_id, '# ' || __TT__ || CASE WHEN summary <> '' THEN E'\n\n> ' || __SU__ ELSE '' END || coalesce(string_agg(line, '' ORDER BY section_pos, link_pos), '') || E'\n' llms_txt FROM ln GROUP BY site_id, name, summary
"""
for _k, _v in {"__LT__": _ws("lt"), "__NT__": _SAFE.format(_ws("notes")), "__TT__": _SAFE.format("name"), "__SU__": _SAFE.format("summary")}.items():
    _RENDER = _RENDER.replace(_k, _v)

QUERIES = {
    "url_normalize": url_normalize, "url_parts": url_parts, "same_site": same_site, "resolve_links": resolve_links, "classify_pages": classify_pages, "score_pages": score_pages, "rank_pages": rank_pages,
    "top_highlights": top_highlights, "site_sections": site_sections, "section_budget": section_budget, "site_profiles": site_profiles, "render_index": render_index, "render_full": render_full,
    "validate_rendered": validate_rendered, "text_functions": text_functions,
}
_SEGS = "list_filter(string_split(path, '/'), lambda s: s <> '')"
_FILES = "'png','jpg','jpeg','gif','svg','webp','avif','ico','bmp','css','js','mjs','map','json','xml','rss','atom','pdf','zip','gz','tar','dmg','exe','pkg','woff','woff2','ttf','mp4','webm','mp3','wav','mov','csv','txt'"
_BASE = f"CASE WHEN path LIKE '%/' THEN path WHEN len({_SEGS}) = 0 THEN '/' WHEN contains({_SEGS}[-1], '.') THEN '/' || array_to_string({_SEGS}[1:-2], '/') ELSE path || '/' END"
_RANKED = PAGES_SQL + f", sc AS (SELECT *, {SCORE_SQL} score FROM pg)"
SQL = {
    "url_normalize": PAGES_SQL + "SELECT seq, site_id, url FROM pg",
    "url_parts": PAGES_SQL
    + rf"""SELECT seq, nhost AS host, path, CAST(len({_SEGS}) AS BIGINT) n_segments, {_BASE} base_path, NOT (lower(regexp_extract(path, '\.([^.]*)$', 1)) IN ({_FILES})) likely,
    {label_sql(f"coalesce({_SEGS}[-1], 'Home')")} path_title FROM pg""",
    "same_site": PAGES_SQL
    + r""", eb AS (SELECT *, regexp_extract(entry_url, '^https?://([^/]*)', 1) eh, CASE WHEN regexp_extract(entry_url, '^https?://[^/]*(.*)$', 1) IN ('', '/') THEN '/' ELSE regexp_extract(entry_url, '^https?://[^/]*(.*)$', 1) END ep FROM en)
    SELECT site_id, count(*) pages, count(*) FILTER (nhost = eh) same_site, count(*) FILTER (nhost = eh AND (ep = '/' OR starts_with(path, ep))) in_scope FROM pg JOIN eb USING (site_id) GROUP BY site_id""",
    "resolve_links": PAGES_SQL
    + """, b AS (SELECT seq, regexp_extract(url, '^https?://[^/]*') o, string_split(ltrim(path, '/'), '/') s FROM pg), c AS (SELECT seq, o, s[1:greatest(len(s) - 2, 0)] d FROM b)
SELECT seq, o || '/' || array_to_string(list_concat(d, ['up', 'x']), '/') || '?a=1&b=2' resolved, o || '/' || array_to_string(list_concat(d, ['md', seq || '.md']), '/') markdown FROM c""",
    "classify_pages": PAGES_SQL + "SELECT seq, path, kind FROM pg",
    "score_pages": _RANKED + "SELECT seq, round(score, 6) score FROM sc",
    "rank_pages": _RANKED + "SELECT site_id, seq, url, kind, round(score, 6) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, seq) rank FROM sc) WHERE rank <= 50",
    "top_highlights": _RANKED + "SELECT site_id, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, seq) rank FROM sc WHERE score > 0) WHERE rank <= 5",
    "site_sections": _links_sql(25, 120) + "SELECT * FROM li",
    "section_budget": _links_sql(3, 12) + "SELECT * FROM li",
    "site_profiles": PAGES_SQL + _HEADS + "SELECT * FROM pr",
    "render_index": _links_sql(25, 120) + _HEADS + _RENDER,
    "text_functions": "SELECT doc_id, CASE WHEN "
    + _ws("text")
    + " = '' THEN 0 ELSE len(string_split("
    + _ws("text")
    + ", ' ')) END words, "
    + _lead_sql("text", 180)
    + " AS lead, substr(sha256(coalesce(title, '') || chr(0) || chr(0) || text), 1, 16) content_hash FROM documents",
}


def _more_sql() -> dict[str, str]:
    from sitequarry.plans.history_queries import _LINES

    safe = _SAFE.format(_ws("coalesce(title, '')"))
    lines = _LINES(SQL["render_index"], "site_id", "llms_txt")
    return {
        "validate_rendered": lines + ", k AS (SELECT site_id, count(*) FILTER (level = 'error') errors FROM i GROUP BY 1), m AS (SELECT site_id, count(*) FILTER (role = 'section') sections, count(*) FILTER (role = 'link') links FROM u GROUP BY 1) "
        "SELECT f.site_id, coalesce(errors, 0) = 0 valid, coalesce(errors, 0) errors, coalesce(sections, 0) sections, coalesce(links, 0) links FROM f LEFT JOIN k USING (site_id) LEFT JOIN m USING (site_id)",
        "render_full": f"WITH ri AS ({SQL['render_index']}), pt AS ({PAGES_SQL} SELECT site_id, seq, url, title, text FROM pg WHERE text <> '') "
        f"SELECT site_id, 0 part, llms_txt chunk FROM ri UNION ALL SELECT site_id, seq + 1, '# ' || {safe} || E'\\n\\nSource: ' || url || E'\\n\\n' || text || E'\\n\\n---' FROM pt",
    }


SQL |= _more_sql()
