"""The checks: what a site's recorded pages, permissions and probes say, as (site, check_id, status, reason, pages, roles, confidence).

Page checks are flags of one projection over the parsed pages and one aggregation by site; site checks are aggregates of the same
pass or joins to the small tables of recorded answers. A check that could not be judged says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import dim
from webgrain.functions.extend import REGISTERED
from webgrain.functions.text import copyright_years, matches, normal_name, parse_date, word_count, words
from webgrain.functions.url import canonical_key, host, path, registrable_domain, same_site, without_www
from webgrain.operators import evidence as E
from webgrain.operators import entities, nodes
from webgrain.operators.facts import ORG_TYPES, address_label, lead_words, text_phone, typed, value_of
from webgrain.operators.html import body_fraction

THIN_WORDS = 60
HEAVY_BYTES = 1 << 20
SMALL_IMAGE = 50
RESULT = "site string, check_id string, status string, reason string, pages array<string>, roles array<string>, confidence string, detail string"  # and evidence


#: The parts of a document that prepare() reads for a page's state and language.
STATE_PARTS = ("lang", "body_text", "noscript", "body_onload", "inline_scripts", "headings", "empty_roots", "script_bytes", "external_scripts")

# ---- states of a page -----------------------------------------------------------------------


def gate_signals() -> Column:
    return F.filter(F.array(
        F.when(F.exists("noscript", lambda t: F.lower(t).contains("javascript")), "noscript_mentions_javascript"),
        F.when(matches(F.col("body_text"), "gate_text"), "gate_text"),
        F.when(F.col("body_onload") | matches(F.col("inline_scripts"), "form_submit"), "script_form_submit")), lambda s: s.isNotNull())


def shell_signals() -> Column:
    h1s = F.filter("headings", lambda h: h["tag"] == "h1")
    return F.filter(F.array(
        F.when(F.size("empty_roots") > 0, "empty_root_container"),
        F.when((F.col("script_bytes") > 10 * F.octet_length("body_text")) & (F.col("script_bytes") > 2000), "script_heavy"),
        F.when((F.size("external_scripts") >= 2) & (F.col("word_count") < 20) & (F.size(h1s) == 0), "scripts_without_content")), lambda s: s.isNotNull())


def render_state() -> Column:
    """ok, gate (asks for scripts), shell (an empty frame) or none (thin without a sign of either)."""
    thin = F.col("word_count") < THIN_WORDS
    return F.when(~thin, "ok").when(F.size(gate_signals()) > 0, "gate").when(F.size(shell_signals()) > 0, "shell").otherwise("none")


def challenge_vendor(status: Column, headers: Column, body: Column) -> Column:
    """The vendor of a bot challenge by its rule's headers and words, null for an ordinary page. A generic captcha counts only on thin pages."""
    low, count = F.lower(F.substring(body, 1, 200_000)), word_count(F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " "))
    out = F.lit(None).cast("string")
    for vendor, wanted, tokens in reversed(V.CHALLENGE_RULES):
        ok = F.lit(True)
        for name, value in (wanted or {}).items():
            ok = ok & ((status == int(value)) if name == "_status" else F.coalesce(F.lower(F.try_element_at(headers, F.lit(name))), F.lit("")).contains(str(value or "").lower()))
        if tokens:
            ok = ok & F.greatest(*[low.contains(t) for t in tokens], F.lit(False))
        refused = status.isin(403, 429, 503) | (count < THIN_WORDS)
        out = F.when(ok & refused, F.lit(vendor)).otherwise(out)
    return out


def classify(docs: DataFrame) -> DataFrame:
    """docs with render_state and `excluded`, the reason why a page is not usable (null: usable). Without fetch columns every page was served."""
    have = set(docs.columns)
    col = lambda c, default: F.col(c) if c in have else F.lit(default)
    rows = docs.withColumns({"render_state": render_state(), "status": col("status", 200).cast("int"), "challenge": F.coalesce(col("challenge", False), F.lit(False)),
                             "skipped": col("skipped", None).cast("string"), "error": col("error", None).cast("string"), "is_html": F.coalesce(col("is_html", True), F.lit(True)),
                             "headers": col("headers", None).cast("map<string,string>") if "headers" in have else F.create_map().cast("map<string,string>"), "final_url": F.col("final_url") if "final_url" in have else F.col("url")})
    return rows.withColumn("excluded", F.when(F.col("skipped").isNotNull(), F.col("skipped")).when(F.col("challenge"), "challenge_page")
                           .when(F.col("error") == "network_disabled", "network_disabled").when(F.col("error").isNotNull() | (F.col("status") >= 400), "http_error")
                           .when(~F.col("is_html"), "non_html").when(F.col("render_state").isin("gate", "shell"), "no_rendered_content"))


def main_reason(pages: DataFrame) -> DataFrame:
    """(site, reason): why a site has no usable page."""
    home_closed = F.bool_or((F.col("role") == "home") & (F.col("skipped") == "robots_disallow"))
    all_of = lambda r: F.bool_and(F.col("excluded") == r)
    return pages.groupBy("site").agg(F.when(home_closed, "robots_disallow").when(all_of("network_disabled"), "network_disabled").when(all_of("challenge_page"), "challenge_page")
                                     .when(F.bool_or(F.col("excluded") == "no_rendered_content"), "no_rendered_content").when(all_of("non_html"), "non_html")
                                     .otherwise("no_html_pages").alias("reason"), F.bool_or(F.col("excluded").isNull()).alias("has_usable"))


# ---- page checks ----------------------------------------------------------------------------


def _meta(key: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit(""))), F.lit(""))


def _h1s(visible: bool = False) -> Column:
    return F.filter("headings", lambda h: (h["tag"] == "h1") & (~h["hidden"] | F.lit(not visible)))


def _frac(mpos: Column) -> Column:
    return body_fraction(mpos, F.col("body_mpos"), F.col("content_mpos"))


def _content_words(text: Column) -> Column:
    return F.filter(F.array_distinct(words(F.lower(text))), lambda w: (F.char_length(w) >= 4) & ~w.isin(*V.CONTENT_STOPWORDS))


def generic_title() -> Column:
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    return title.isin(*V.GENERIC_TITLES) | (title == F.col("site")) | (title == without_www(F.col("site"))) | (F.char_length(title) < 3)


def title_mismatch() -> Column:
    """Whether the first headline shares no content word with title and description, and stands in neither."""
    h1, about = F.trim(F.get(_h1s(True), F.lit(0))["text"]), F.concat_ws(" ", "title", _meta("description"))
    own = _content_words(h1)
    gradable = (F.coalesce(h1, F.lit("")) != "") & ~generic_title() & (F.size(own) > 0)
    return gradable & ~F.arrays_overlap(own, _content_words(about)) & ~F.lower(about).contains(F.lower(h1))


def search_form(form: Column) -> Column:
    return (form["role"] == "search") | matches(F.concat_ws(" ", form["id"], form["cls"], form["label"], form["action"]), "search_word") | F.exists(
        form["inputs"], lambda i: (i["type"] == "search") | F.coalesce(F.lower(i["name"]).isin(*V.SEARCH_INPUT_NAMES), F.lit(False)) | matches(i["placeholder"], "search_word"))


def site_search() -> Column:
    return (F.col("search_roles") > 0) | F.exists("forms", search_form)


def nav_landmark() -> Column:
    listed = F.array_distinct(F.transform(F.filter("links", lambda x: x["internal"] & x["in_list"] & (x["context"] == "header")), lambda x: F.regexp_replace(x["url"], "/+$", "")))
    return (F.col("nav_count") > 0) | (F.size(listed) >= 3)


def cta_hit() -> Column:
    """Whether a page asks its visitor to act: a link in header or nav, or in the first part of the content; a button or form there. Needs `category`, `page_lang`."""
    def phrases(values) -> str:
        return r"(?iuU)\b(?:" + "|".join(v.replace(" ", r"\s+") for v in values) + r")\b"
    says = lambda t: (F.coalesce(*[F.when(F.col("category") == c, t.rlike(phrases(v))) for c, v in V.CTA_VOCAB.items()], t.rlike(phrases(V.CTA_VOCAB["unknown"])))
                      | t.rlike(phrases(V.CTA_UNIVERSAL)) | F.coalesce(*[F.when(F.col("page_lang") == k, t.rlike(phrases(v))) for k, v in V.CTA_VOCAB_BY_LANG.items()], F.lit(False)))
    early = lambda m: F.coalesce(_frac(m) <= V.FIRST_VIEWPORT_FRAC, F.lit(False))
    takes_mail = F.col("category").isin(*[c for c, v in V.CTA_VOCAB.items() if {"email", "contact"} & set(v)])
    takes_call = F.col("category").isin(*[c for c, v in V.CTA_VOCAB.items() if {"call", "contact"} & set(v)])
    direct = lambda x: (F.lower(x["href"]).startswith("mailto:") & (takes_mail | (F.col("role") == "contact"))) | (F.lower(x["href"]).startswith("tel:") & (takes_call | (F.col("role") == "contact")))
    return (F.exists("links", lambda x: ~x["in_head"] & ((says(x["text"]) & (x["context"].isin("header", "nav") | early(x["mpos"]))) | direct(x)))
            | F.exists("buttons", lambda b: says(b["text"]) & early(b["mpos"])) | F.exists("forms", lambda f: early(f["mpos"]) & ~search_form(f)))


def hero_signals() -> Column:
    h1 = F.get(_h1s(), F.lit(0))["text"]
    visible = F.get(_h1s(True), F.lit(0))["text"]
    n = word_count(visible)
    lead = F.array_join(lead_words(F.col("body_text"), F.coalesce(visible, F.lit(""))), " ")
    verbs = r"(?iuU)\b(?:" + "|".join(V.OFFER_VERBS) + r")\b"
    nouns = F.coalesce(*[F.when(F.col("category") == c, lead.rlike(r"(?iuU)\b(?:" + "|".join(v) + r")(?:s|es|ing|ed)?\b")) for c, v in V.CATEGORY_NOUNS.items()], F.lit(False))
    return F.filter(F.array(
        F.when(F.size(_h1s()) == 0, "h1_missing").when(F.trim(h1) == "", "h1_empty").when(visible.isNull(), "h1_hidden_only").when(n < 3, "h1_too_short").when(n > 25, "h1_too_long"),
        F.when(~nouns & ~lead.rlike(verbs), "lead_text_no_offer")), lambda s: s.isNotNull())


def related_links_missing() -> Column:
    inner = lambda x: x["internal"] & ~x["in_head"]
    listing = (F.col("article_count") >= 2) | (F.size(F.filter("links", lambda x: inner(x) & x["in_list"] & x["context"].isin("main", "body", "article"))) >= V.LISTING_MIN_LINKS)
    late = F.array_distinct(F.transform(F.filter("links", lambda x: ~x["in_head"] & x["url"].rlike("^https?:") & (registrable_domain(host(x["url"])) == registrable_domain(F.col("site"))) & ~x["context"].isin(
        "nav", "header", "footer") & (_frac(x["mpos"]) >= 0.5)), lambda x: x["url"]))
    return F.col("role").isin("product", "blog") & ~listing & ~F.exists("headings", lambda h: matches(h["text"], "related_heading")) & (F.size(late) < V.RELATED_MIN_LINKS)


def interstitial() -> Column:
    first = F.get(_h1s(), F.lit(0))["mpos"]
    before = lambda o: F.when(first.isNotNull(), o["mpos"] < first).otherwise(_frac(o["mpos"]) <= V.FIRST_VIEWPORT_FRAC)
    return F.exists("overlays", lambda o: ~o["hidden"] & (o["words"] > V.INTERSTITIAL_MIN_WORDS) & F.coalesce(before(o), F.lit(False)))


def content_images() -> Column:
    small = lambda v: F.coalesce(v < SMALL_IMAGE, F.lit(False))
    return F.filter("images", lambda i: (i["role"] != "presentation") & (F.coalesce(i["alt"], F.lit("-")) != "") & ~small(i["width"]) & ~small(i["height"]))


def alt_missing() -> Column:
    own = content_images()
    without = F.size(F.filter(own, lambda i: i["alt"].isNull()))
    return (F.size(own) >= 3) & (without >= 2) & (without > 0.3 * F.size(own))


def image_fact_signals(kind: str) -> Column:
    """Per page, the most signals by which one image labels a kind of fact: its short alt text, its file name, the heading before it."""
    raw, flags = V.IMAGE_FACT_WORDS[kind]
    says = lambda t: F.coalesce(t, F.lit("")).rlike(f"(?uU{flags.lower()})" + raw)
    few = lambda t, n: F.size(F.split(F.trim(F.coalesce(t, F.lit(""))), r"\s+")) <= n
    def of(i: Column) -> Column:
        above = F.filter("headings", lambda h: h["pos"] <= i["pos"])
        nearest = F.try_element_at(above, F.lit(-1))["text"]
        name = F.regexp_replace(F.regexp_extract(i["src"], r"([^/?#]*?)(?:\.[A-Za-z0-9]+)?(?:[?#].*)?$", 1), r"[-_]+", " ")
        return (says(i["alt"]) & few(i["alt"], 5)).cast("int") + says(name).cast("int") + (says(nearest) & few(nearest, 4)).cast("int")
    return F.coalesce(F.array_max(F.transform(content_images(), of)), F.lit(0))


def image_only() -> Column:
    """Signals of an image that carries a fact its page does not write out; 0 for none."""
    text = F.col("body_text")
    written = {"pricing": matches(text, "price"), "hours": matches(text, "hours"), "address": address_label(text).isNotNull(), "menu": matches(text, "price"), "specs": F.lit(True)}
    return F.greatest(*[F.when(F.col("role").isin(*V.IMAGE_FACT_PAGES.get(kind, ())) & ~written[kind], image_fact_signals(kind)).otherwise(0) for kind in V.IMAGE_FACT_WORDS])


def lacking_properties() -> Column:
    """Nodes of a known type or family, with the required properties they lack (see nodes.lacking)."""
    return nodes.lacking(F.col("nodes"))


def date_mismatch(as_of: Column) -> Column:
    """Whether structured data is dated after tomorrow, or over 30 days from the nearest date the page shows."""
    seen = F.filter(F.transform(F.concat("times", F.regexp_extract_all("body_text", F.lit(r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b"), F.lit(0)), F.regexp_extract_all(
        "body_text", F.lit(r"(?i)\b(?:\d{1,2}(?:st|nd|rd|th)?\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:\d{1,2}(?:st|nd|rd|th)?,?\s+)?(?:19|20)\d{2}\b"), F.lit(0))),
        parse_date), lambda d: d.isNotNull())
    told = F.filter(F.transform(F.filter("nodes", lambda n: n["top"]), lambda n: parse_date(F.coalesce(value_of(n["json"], "dateModified"), value_of(n["json"], "datePublished")))), lambda d: d.isNotNull())
    far = lambda d: F.coalesce(F.array_min(F.transform(seen, lambda s: F.abs(F.date_diff(s, d)))) > V.MISMATCH_DAYS, F.lit(False))
    return F.exists(told, lambda d: (d > F.date_add(as_of, 1)) | far(d))


def visible_date() -> Column:
    return (F.size("times") > 0) | matches(F.col("body_text"), "iso_date") | matches(F.col("body_text"), "text_date") | matches(F.col("body_text"), "copyright_year")


def page_flags(as_of: Column) -> dict[str, tuple[Column, Column, Column]]:
    """check id -> (pages judged, pages that fail, confidence or null). Over pages of prepare()."""
    usable, served, key = F.col("excluded").isNull(), F.col("excluded").isNull() | (F.col("excluded") == "no_rendered_content"), F.col("is_key")
    none, low_or_medium = F.lit(None).cast("string"), lambda n: F.when(n >= 2, "medium").otherwise("low")
    home = F.col("role") == "home"
    canonical = F.col("canonical").isNotNull()
    offsite = canonical & (registrable_domain(host(F.col("canonical"))) != registrable_domain(F.col("site")))
    return {
        "cr.access.http_error": (F.lit(True), F.col("skipped").isNull() & ~F.col("challenge") & (F.col("error").isNotNull() | (F.col("status") >= 400)), none),
        "cr.render.js_gate": (served, F.col("render_state") == "gate", none),
        "cr.render.csr_shell": (served, F.col("render_state") == "shell", low_or_medium(F.size("shell_signs"))),
        "cr.index.noindex_on_key_page": (served & key, F.lower(F.concat_ws(", ", _meta("robots"), _meta("googlebot"), _meta("bingbot"), F.try_element_at("headers", F.lit("x-robots-tag")))).contains("noindex"), none),
        "cr.index.canonical_offsite": (served, offsite, none),
        "cr.index.canonical_mismatch": (served, canonical & ~offsite & (canonical_key(F.col("canonical")) != canonical_key(F.col("final_url"))), none),
        "fx.facts.image_only": (usable, F.col("image_signs") > 0, low_or_medium(F.col("image_signs"))),
        "fx.jsonld.malformed": (usable, F.exists("jsonld", lambda b: b["error"].isNotNull()), none),
        "fx.jsonld.required_props_missing": (usable, F.size("lacking") > 0, none),
        "fx.identity.title_missing_or_generic": (usable, generic_title(), none),
        "fx.identity.h1_missing_or_multiple": (usable, F.size(_h1s()) != 1, none),
        "fx.identity.meta_description_missing": (usable, _meta("description").isNull(), none),
        "fx.identity.og_missing": (usable, _meta("og:title").isNull() & _meta("og:description").isNull(), none),
        "fx.media.alt_text_missing": (usable, alt_missing(), none),
        "ef.freshness.date_modified_mismatch": (usable, date_mismatch(as_of), none),
        "en.hero.value_prop_unclear": (usable & home, F.size("hero_signs") > 0, low_or_medium(F.size("hero_signs"))),
        "en.cta.missing": (usable & key & (F.col("page_lang").isNull() | F.col("page_lang").isin("en", *V.CTA_VOCAB_BY_LANG)), ~cta_hit(), none),
        "en.mobile.viewport_missing": (served, _meta("viewport").isNull(), none),
        "en.perf.page_weight_heavy": (served, (F.col("html_bytes") > HEAVY_BYTES) | (F.col("script_tags") > V.HEAVY_SCRIPT_TAGS) | (F.size("images") > V.HEAVY_IMAGES), F.lit("low")),
        "en.continuity.h1_title_mismatch": (usable, title_mismatch(), none),
        "en.nav.related_links_missing": (usable, related_links_missing(), none),
        "en.interstitial.blocking": (usable, interstitial(), none),
    }


def page_evidence() -> dict[str, Column]:
    """check id -> what a failing page shows, as items without a page; checks that are not named show the page alone."""
    joined = lambda c: F.array_join(c, ",")
    link = F.concat(F.lit('<link rel="canonical" href="'), F.col("canonical"), F.lit('">'))
    bad_blocks = F.filter(F.transform("jsonld", lambda b, i: F.struct(i.alias("i"), b["error"].alias("error"), F.substring(b["raw"], -160, 160).alias("raw"))), lambda b: b["error"].isNotNull())
    own = content_images()
    robots_meta = F.concat_ws(", ", _meta("robots"), _meta("googlebot"), _meta("bingbot"))
    return {
        "cr.access.http_error": E.items(E.item("http_status", F.coalesce(F.col("status").cast("string"), F.concat(F.lit("error="), F.col("error"))), note=F.col("error"))),
        "cr.access.challenge_page": E.items(E.item("http_status", F.concat_ws(" ", F.col("status").cast("string"), F.lit("challenge=true")))),
        "cr.render.js_gate": E.items(E.item("computed", F.concat(F.lit("visible_words="), F.col("word_count"), F.lit("; signals="), joined(F.col("gate_signs")))),
                                     E.item("text_excerpt", F.substring(F.coalesce(F.get("noscript", F.lit(0)), F.col("body_text")), 1, 200))),
        "cr.render.csr_shell": E.items(E.item("computed", F.concat(F.lit("visible_words="), F.col("word_count"), F.lit("; script_bytes="), F.col("script_bytes"), F.lit("; external_scripts="),
                                                                   F.size("external_scripts"), F.lit("; signals="), joined(F.col("shell_signs"))))),
        "cr.index.noindex_on_key_page": E.items(F.when(F.lower(robots_meta).contains("noindex"), E.item("html_excerpt", F.concat(F.lit('<meta name="robots" content="'), robots_meta, F.lit('">')), location="head > meta[name=robots]")).otherwise(
            E.item("http_header", F.concat(F.lit("x-robots-tag: "), F.try_element_at("headers", F.lit("x-robots-tag")))))),
        "cr.index.canonical_offsite": E.items(E.item("html_excerpt", link, location="head > link[rel=canonical]")),
        "cr.index.canonical_mismatch": E.items(E.item("html_excerpt", link, location="head > link[rel=canonical]")),
        "fx.facts.image_only": E.items(E.item("computed", F.concat(F.lit("visible_words="), F.col("word_count"), F.lit("; image_signals="), F.col("image_signs")))),
        "fx.jsonld.malformed": F.transform(bad_blocks, lambda b: E.item("jsonld_excerpt", b["raw"], location=block_location(b["i"]), note=b["error"])),
        "fx.jsonld.required_props_missing": F.transform("lacking", lambda m: E.item(
            "jsonld_excerpt", F.concat_ws(" ", m["type"], F.concat(F.lit("as "), m["as_type"]), F.when(F.size(m["missing"]) > 0, F.concat(F.lit("missing="), joined(m["missing"]))),
                                          F.when(F.size(m["unmet"]) > 0, F.concat(F.lit("none of="), joined(m["unmet"])))), location=block_location(m["block"]), note=m["id"])),
        "fx.identity.title_missing_or_generic": E.items(E.item("html_excerpt", F.coalesce(F.concat(F.lit("<title>"), F.col("title"), F.lit("</title>")), F.lit("(no title element)")), location="head > title")),
        "fx.identity.h1_missing_or_multiple": E.items(E.item("computed", F.concat(F.lit("h1_count="), F.size(_h1s())))),
        "fx.identity.meta_description_missing": E.items(E.item("computed", "meta_description=absent")),
        "fx.identity.og_missing": E.items(E.item("computed", "og:title=absent; og:description=absent")),
        "fx.media.alt_text_missing": E.items(E.item("computed", F.concat(F.lit("images="), F.size(own), F.lit("; missing_alt="), F.size(F.filter(own, lambda i: i["alt"].isNull()))))),
        "ef.freshness.date_modified_mismatch": E.items(E.item("jsonld_excerpt", F.concat(F.lit("dates="), F.array_join(F.filter(F.transform("nodes", lambda n: F.coalesce(value_of(n["json"], "dateModified"), value_of(n["json"], "datePublished"))), lambda v: v.isNotNull()), ",")))),
        "en.hero.value_prop_unclear": E.items(E.item("text_excerpt", F.coalesce(F.get(_h1s(), F.lit(0))["text"], F.lit("(no h1)")), location="h1"), E.item("computed", F.concat(F.lit("signals="), joined(F.col("hero_signs"))))),
        "en.cta.missing": E.items(E.item("computed", F.concat(F.lit("links="), F.size("links"), F.lit("; buttons="), F.size("buttons"), F.lit("; matched=0")))),
        "en.mobile.viewport_missing": E.items(E.item("computed", "meta_viewport=absent", note=F.concat("role", F.lit(" page")))),
        "en.perf.page_weight_heavy": E.items(E.item("computed", F.concat(F.lit("html_bytes="), F.col("html_bytes"), F.lit("; script_tags="), F.col("script_tags"), F.lit("; images="), F.size("images")), note=F.concat("role", F.lit(" page")))),
        "en.continuity.h1_title_mismatch": E.items(E.item("computed", F.concat(F.lit("h1="), F.substring(F.get(_h1s(True), F.lit(0))["text"], 1, 60), F.lit("; title="), F.substring("title", 1, 60), F.lit("; shared_words=none")), note=F.concat("role", F.lit(" page")))),
        "en.nav.related_links_missing": E.items(E.item("computed", "related_heading=none", note=F.concat("role", F.lit(" page")))),
        "en.interstitial.blocking": F.transform(F.slice(F.filter("overlays", lambda o: ~o["hidden"] & (o["words"] > V.INTERSTITIAL_MIN_WORDS)), 1, 3), lambda o: E.item("computed", F.concat(F.lit("overlay_words="), o["words"]))),
        "or.run.probe_error": E.items(E.item("computed", F.concat(F.lit("parse_error="), F.col("parse_error")))),
    }


def block_location(i: Column) -> Column:
    """Where a page's block of structured data stands, from 1."""
    return F.concat(F.lit("script[type=application/ld+json]["), (i + 1).cast("string"), F.lit("]"))


def site_evidence() -> dict[str, str]:
    """check id -> what was looked for on the judged pages and not found. Fixed values, one computed item a site."""
    return {
        "cr.access.non_html_seed": "is_html=false", "fx.jsonld.missing": "jsonld_blocks=0", "fx.jsonld.no_organization": "organization_nodes=0",
        "fx.content.faq_absent": "faq_heading=false; FAQPage=false", "ef.entity.sameas_missing": "sameAs=absent", "ef.entity.sameas_no_authority": "sameAs_authority=none",
        "ef.freshness.no_visible_dates": "time_elements=0; text_dates=0; copyright_year=none", "ef.freshness.stale_copyright_year": "copyright_year=stale",
        "ef.corroboration.press_page_missing": "press_links=0; feeds=0", "en.nav.landmark_missing": "nav_elements=0; role_navigation=0", "en.nav.breadcrumbs_missing": "breadcrumb_markup=false; BreadcrumbList=false",
        "en.nav.site_search_missing": "search_roles=0; search_inputs=0", "en.lang.attribute_missing": "html_lang=absent",
    }


def site_flags(as_of: Column) -> dict[str, tuple[Column, Column]]:
    """check id -> (pages judged, aggregate over all pages of the site that is true when those judged fail)."""
    def no(judged: Column, there: Column) -> tuple[Column, Column]:
        return judged, ~F.bool_or(F.coalesce(judged & there, F.lit(False)))

    usable, home = F.col("excluded").isNull(), F.col("role") == "home"
    anchor, seed = usable & home, home & (F.col("status") == 200) & ~F.col("challenge") & F.col("skipped").isNull()
    owners = nodes.owners(F.lit(True))
    has_org = F.size(nodes.owners(F.col("category") == "portfolio_personal")) > 0
    urls = F.array_distinct(F.flatten(F.transform(owners, lambda n: F.regexp_extract_all(F.coalesce(value_of(n["json"], "sameAs"), F.lit("")), F.lit(r"https?://[^\"\s,\]]+"), F.lit(0)))))
    marked, anchors = usable & (F.size("jsonld") > 0), usable & F.col("role").isin("home", "about")
    first_has = F.min_by(has_org, F.when(usable, F.col("page_ord")))
    no_owner = F.when(F.bool_or(anchors), ~F.bool_or(F.coalesce(anchors & has_org, F.lit(False)))).otherwise(~F.coalesce(first_has, F.lit(False)))
    authority = F.exists(urls, lambda u: F.greatest(*[host(u).contains(a) for a in V.AUTHORITY_HOSTS]) | (F.greatest(*[host(u).contains(a) for a in V.PROFILE_HOSTS]) & (F.col("category") == "portfolio_personal")))
    press = F.exists("links", lambda x: x["internal"] & (matches(x["text"], "press_link") | F.coalesce(F.lower(F.element_at(F.split(path(x["url"]), "/"), 2)).isin(*V.PRESS_PATH_SEGMENTS), F.lit(False))))
    asks = F.size(F.filter("headings", lambda h: h["tag"].isin("h2", "h3", "h4") & F.rtrim(h["text"]).endswith("?"))) >= 3
    faq = (F.size(typed(("FAQPage",), top=False)) > 0) | F.exists("headings", lambda h: matches(h["text"], "faq_heading")) | asks
    years = copyright_years(F.col("body_text"), as_of)
    trail = F.col("breadcrumb") | (F.size(typed(("BreadcrumbList",), top=False)) > 0)
    return {
        "cr.access.non_html_seed": (seed, F.bool_or(seed & ~F.col("is_html"))),
        "fx.jsonld.missing": no(usable, F.size("jsonld") > 0),
        "fx.jsonld.no_organization": (marked, no_owner),
        "fx.content.faq_absent": no(usable, faq),
        "ef.entity.sameas_missing": no(usable & (F.size(owners) > 0), F.size(urls) > 0),
        "ef.entity.sameas_no_authority": no(usable & (F.size(urls) > 0), authority),
        "ef.freshness.no_visible_dates": no(usable, visible_date()),
        "ef.freshness.stale_copyright_year": (usable & (F.size(years) > 0), F.max(F.when(usable, F.array_max(years))) <= F.year(F.first(as_of)) - V.STALE_YEARS),
        "ef.corroboration.press_page_missing": no(usable, press | (F.size("feeds") > 0) | (F.col("role") == "blog")),
        "en.nav.landmark_missing": no(anchor, nav_landmark()),
        "en.nav.breadcrumbs_missing": no(usable & ~home, trail),
        "en.nav.site_search_missing": no(anchor, site_search()),
        "en.lang.attribute_missing": (anchor, F.bool_or(anchor & F.col("lang").isNull())),
    }


#: What several flags and their evidence look at, worked out once for a page.
SIGNS = {"gate_signs": gate_signals, "shell_signs": shell_signals, "hero_signs": hero_signals, "image_signs": image_only, "lacking": lacking_properties}


def prepare(docs: DataFrame, sites: DataFrame, signs: tuple[str, ...] = tuple(SIGNS)) -> DataFrame:
    """Pages with their state, their site's category, their language, whether their role is a key page of the category, and signs. sites: site, category."""
    keys = F.broadcast(dim(docs.sparkSession, "key_page").select("category", "role", F.lit(True).alias("is_key")))
    rows = classify(docs).join(sites.select("site", "category"), "site", "left").fillna({"category": "unknown"})
    rows = rows.join(keys, ["category", "role"], "left").withColumns({"is_key": F.coalesce("is_key", F.lit(False)), "page_lang": F.lower(F.substring_index("lang", "-", 1))})
    return rows.withColumns({k: SIGNS[k]() for k in signs}) if signs else rows


def grade_pages(pages: DataFrame, as_of: Column, only: tuple[str, ...] | None = None) -> DataFrame:
    """Results of all page and site checks (or of those that only names) over prepare()d pages: one aggregation by site and check for page checks, one by site for site checks."""
    pages = pages if "page_ord" in pages.columns else pages.withColumn("page_ord", F.lit(0))
    added = {k: f() for k, f in REGISTERED.page_checks.items()}
    flags = page_flags(as_of) | {k: (f.judged, f.failed, F.lit(None).cast("string") if f.confidence is None else f.confidence) for k, f in added.items()}
    flags |= {k: (F.lit(True), hit, F.lit(None).cast("string")) for k, hit in open_flags().items()}
    asked = lambda checks: {k: v for k, v in checks.items() if only is None or k in only}
    flags, sums = asked(flags), asked(site_flags(as_of))
    if not sums:
        return _page_results(pages, flags, added)
    results = _site_results(pages, sums)
    return _page_results(pages, flags, added).unionByName(results) if flags else results


def _page_results(pages: DataFrame, flags: dict[str, tuple[Column, Column, Column]], added: dict) -> DataFrame:
    # the flags are computed once for each page, in one projection, and carried as one array
    shown = page_evidence() | {k: f.evidence.cast(E.EVIDENCE) for k, f in added.items() if f.evidence is not None}
    found = F.array(*[F.struct(F.lit(k).alias("check_id"), F.coalesce(judged, F.lit(False)).alias("judged"), F.coalesce(judged & failed, F.lit(False)).alias("failed"), conf.alias("confidence"),
                               F.when(judged & failed, shown.get(k, E.none())).alias("evidence"))
                      for k, (judged, failed, conf) in flags.items()])
    rows = pages.select("site", "category", "page_ord", "final_url", "role", F.inline(found))
    worst = F.max(F.when(F.col("failed"), F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("confidence"))))
    hit = F.col("failed")
    by_page = rows.groupBy("site", "check_id").agg(
        F.bool_or("judged").alias("judged"), F.array_sort(F.collect_list(F.when(hit, F.struct("page_ord", "final_url", "role", F.coalesce("evidence", E.none()).alias("evidence"))))).alias("hits"),
        F.try_element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.nullif(worst, F.lit(0)).cast("int")).alias("confidence"))
    left_open = F.coalesce(*[F.when(F.col("check_id") == k, why) for k, why in OPEN_PAGES.items()])
    page_results = by_page.select("site", "check_id", F.when(F.size("hits") > 0, F.when(left_open.isNull(), "fail").otherwise("inconclusive")).when(F.col("judged"), "pass").otherwise("not_evaluated").alias("status"),
                                  F.when(~F.col("judged"), "no_usable_pages").when(F.size("hits") > 0, left_open).alias("reason"), F.transform("hits", lambda h: h["final_url"]).alias("pages"),
                                  F.transform("hits", lambda h: h["role"]).alias("roles"), "confidence",
                                  F.flatten(F.transform("hits", lambda h: E.on_page(h["evidence"], h["final_url"]))).alias("evidence"))
    # a node that several pages repeat is one node: it counts for the first of them
    once = F.aggregate("evidence", E.none(), lambda seen, e: F.when(F.exists(seen, lambda s: s["note"] == e["note"]), seen).otherwise(F.concat(seen, F.array(e))))
    repeated = F.col("check_id") == "fx.jsonld.required_props_missing"
    own_pages = F.array_distinct(F.transform("evidence", lambda e: e["page"]))
    return page_results.withColumn("evidence", F.when(repeated, once).otherwise(F.col("evidence"))).withColumns({
        "roles": F.when(repeated, F.transform(F.filter(F.arrays_zip("pages", "roles"), lambda x: F.array_contains(own_pages, x["pages"])), lambda x: x["roles"])).otherwise(F.col("roles")),
        "pages": F.when(repeated, own_pages).otherwise(F.col("pages"))})


def _site_results(pages: DataFrame, sums: dict[str, tuple[Column, Column]]) -> DataFrame:
    # one aggregation for all site checks: whether any page was judged, and the sum over the judged pages
    sites = pages.groupBy("site").agg(*[F.struct(F.lit(k).alias("check_id"), F.coalesce(F.bool_or(judged), F.lit(False)).alias("judged"), failing.alias("failed"), F.count_if(judged).alias("n")).alias(f"c{i}")
                                        for i, (k, (judged, failing)) in enumerate(sums.items())])
    each = sites.select("site", F.inline(F.array(*[f"c{i}" for i in range(len(sums))])))
    said = F.coalesce(*[F.when(F.col("check_id") == k, v) for k, v in site_evidence().items()])
    return each.select(
        "site", "check_id", F.when(~F.col("judged"), "not_evaluated").when(F.col("failed"), "fail").otherwise("pass").alias("status"),
        F.when(~F.col("judged"), "no_usable_pages").alias("reason"), F.array().cast("array<string>").alias("pages"), F.array().cast("array<string>").alias("roles"), F.lit(None).cast("string").alias("confidence"),
        F.when(F.col("judged") & F.col("failed"), E.items(E.item("computed", F.concat(said, F.lit("; pages="), F.col("n")), page="site"))).otherwise(E.none()).alias("evidence"))


#: Checks that pages leave open, and why: those answered by a bot challenge, and those whose markup could not be read to its end.
OPEN_PAGES = {"cr.access.challenge_page": "challenge_page", "or.run.probe_error": "page_not_read"}


def open_flags() -> dict[str, Column]:
    return {"cr.access.challenge_page": F.col("challenge"), "or.run.probe_error": F.col("parse_error").isNotNull()}


def apply_category(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Checks that a category does not call for are not evaluated; those it calls for weakly fail with low confidence."""
    spark = results.sparkSession
    caps = F.broadcast(dim(spark, "engagement_cap"))
    off = F.broadcast(dim(spark, "severity_override").where("severity = 'not_evaluated'").select("check_id", "category", F.lit(True).alias("off")))
    rows = results.join(sites.select("site", "category"), "site").join(caps, ["check_id", "category"], "left").join(off, ["check_id", "category"], "left")
    none = (F.col("cap") == "no") | F.col("off")
    return rows.withColumns({"reason": F.when(none, "not_applicable_for_category").otherwise(F.col("reason")), "status": F.when(none, "not_evaluated").otherwise(F.col("status")),
                             "capped": F.coalesce(F.col("cap") == "low", F.lit(False))}).drop("cap", "off")


# ---- checks over recorded answers -----------------------------------------------------------


def _rows(df: DataFrame, check_id: str, status: Column, reason: Column | None = None, detail: Column | None = None, evidence: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select("site", F.lit(check_id).alias("check_id"), status.alias("status"), (null if reason is None else reason).alias("reason"),
                     F.array().cast("array<string>").alias("pages"), F.array().cast("array<string>").alias("roles"), null.alias("confidence"), (null if detail is None else detail).alias("detail"),
                     F.when(status != "pass", E.none() if evidence is None else evidence).otherwise(E.none()).alias("evidence"))


def robots_checks(grades: DataFrame, robots: DataFrame, star_allowed: DataFrame) -> DataFrame:
    """grades: grade_tokens(). robots: site, state (ok, missing, unreachable). star_allowed: site, allowed for a token that nobody names."""
    closed = robots.where("state = 'unreachable'").select("site")
    names = [c[0] for c in V.CHECKS if c[0].startswith("cr.robots.") and c[0] != "cr.robots.unreachable"]
    out = _rows(robots, "cr.robots.unreachable", F.when(F.col("state") == "unreachable", "inconclusive").otherwise("pass"), F.when(F.col("state") == "unreachable", "robots_unreachable"),
                evidence=E.items(E.item("http_status", "robots.txt", page="robots.txt", note="5xx, timeout or challenge page")))
    for name in names:
        out = out.unionByName(_rows(closed, name, F.lit("not_evaluated"), F.lit("robots_unreachable")))
    read = robots.where("state <> 'unreachable'").select("site", "state")
    named = F.col("own_group") & ~F.col("root_allowed")
    by_tier = read.join(grades, "site", "left").groupBy("site").agg(
        *[F.array_sort(F.collect_list(F.when(named & (F.col("tier") == t), F.col("token")))).alias(t) for t in ("live_answer", "index", "training_only")],
        F.count_if(F.col("tier") == "live_answer").alias("live_total"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("root_allowed") & F.col("tier").isin("live_answer", "index"), F.col("disallowed_key_paths")))))).alias("paths"))
    fails = lambda cond: F.when(cond, "fail").otherwise("pass")
    rule = lambda tokens, text: F.transform(tokens, lambda t: E.item("robots_rule", F.concat(F.lit(text), t), page="robots.txt"))
    for tier, name in (("live_answer", "live_answer_bot_blocked"), ("index", "index_bot_blocked"), ("training_only", "training_bot_blocked")):
        seen = rule(F.col(tier), "Disallow: / for User-agent: ")
        if tier == "live_answer":  # a site that shuts out every one of them is out of reach for live answers
            every = (F.size(tier) == F.col("live_total")) & (F.size(tier) > 0)
            seen = F.concat(seen, F.when(every, E.items(E.item("computed", F.concat(F.lit("blocked=all of "), F.col("live_total")), page="robots.txt"))).otherwise(E.none()))
        out = out.unionByName(_rows(by_tier, f"cr.robots.{name}", fails(F.size(tier) > 0), None, F.array_join(tier, ","), seen))
    out = out.unionByName(_rows(by_tier, "cr.robots.key_page_disallowed", fails(F.size("paths") > 0), None, F.array_join("paths", ","), rule(F.slice("paths", 1, 8), "Disallow covers ")))
    star = read.join(star_allowed, "site", "left")
    shut = E.items(E.item("robots_rule", "User-agent: * / Disallow: /", page="robots.txt"))
    return out.unionByName(_rows(star, "cr.robots.blanket_disallow", fails(~F.coalesce("allowed", F.lit(True))), evidence=shut))


def edge_checks(probes: DataFrame) -> DataFrame:
    """probes: site, token, tier (baseline for the audit's own agent), status, error, bytes."""
    base, cited = F.col("tier") == "baseline", F.col("tier").isin("live_answer", "index")
    timeout = F.coalesce(F.col("error").isin("timeout", "read_timeout", "connect_timeout"), F.lit(False))
    refused = ~timeout & (F.col("error").isNotNull() | (F.col("status") >= 400))
    agg = probes.groupBy("site").agg(
        F.max(F.when(base, F.col("status"))).alias("base"), F.max(F.when(base, F.col("bytes"))).alias("base_bytes"), F.count_if(cited).alias("cited"), F.count_if(cited & refused).alias("refused"),
        F.count_if(cited & timeout).alias("timeouts"), F.count_if((F.col("tier") == "training_only") & refused).alias("training"),
        F.array_sort(F.collect_list(F.when(~base & ~F.coalesce(F.col("status") < 400, F.lit(False)), F.struct("tier", "token", F.coalesce("error", F.col("status").cast("string")).alias("got"))))).alias("answers"),
        F.max(F.when(~base & (F.col("status") == 200), F.col("bytes"))).alias("most"), F.min(F.when(~base & (F.col("status") == 200), F.col("bytes"))).alias("least"))
    ready = F.col("base") == 200
    main = F.when(~F.coalesce(ready, F.lit(False)), "not_evaluated").when(F.col("cited") == 0, "not_evaluated").when(F.col("refused") > 0, "fail").when(F.col("timeouts") > 0, "inconclusive").otherwise("pass")
    why = F.when(~F.coalesce(ready, F.lit(False)), "no_200_baseline").when(F.col("cited") == 0, "probe_tokens_disallowed").when((F.col("refused") == 0) & (F.col("timeouts") > 0), "probe_timeout")
    differs = F.greatest(F.abs(F.col("most") - F.col("base_bytes")), F.abs(F.col("least") - F.col("base_bytes"))) > 0.5 * F.col("base_bytes")
    got = lambda *tiers: F.transform(F.filter("answers", lambda a: a["tier"].isin(*tiers)), lambda a: E.item("http_status", F.concat(a["token"], F.lit(" -> "), a["got"]), page="site", note="user-agent probe"))
    sizes = E.items(E.item("computed", F.concat(F.lit("bytes="), F.col("least"), F.lit(".."), F.col("most"), F.lit("; baseline="), F.col("base_bytes")), page="site"))
    return (_rows(agg, "cr.access.edge_block", main, why, F.when(F.col("refused") == F.col("cited"), "all_refused"), got("live_answer", "index"))
            .unionByName(_rows(agg, "cr.access.edge_block_training", F.when(ready & (F.col("refused") == 0) & (F.col("training") > 0), "fail").otherwise("pass"), evidence=got("training_only")))
            .unionByName(_rows(agg, "cr.access.ua_content_variance", F.when(ready & (F.col("refused") == 0) & F.coalesce(differs, F.lit(False)), "inconclusive").otherwise("pass"),
                               F.when(ready & (F.col("refused") == 0) & F.coalesce(differs, F.lit(False)), "content_varies_by_agent"), evidence=sizes)))


#: Statuses by which a site refuses a client rather than fails.
REFUSALS = (401, 403, 429)


def split_refusals(results: DataFrame, pages: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """results in which a home page that refused the audit is told from one that is down, by what crawlers got who may read it.

    All of them refused: it fails. None refused: it is open, for the refusal is the audit's own matter. Some, or none asked: open as well, for nobody
    knows. A crawler that was kept waiting was neither served nor refused. probes: as for edge_checks().
    """
    homes = pages.where(F.col("role") == "home").groupBy("site").agg(F.max(F.col("status").isin(*REFUSALS)).alias("_refused"))
    if probes is None:
        asked = homes.select("site", F.lit(0).alias("_asked"), F.lit(0).alias("_denied"))
    else:
        timeout = F.coalesce(F.col("error").isin("timeout", "read_timeout", "connect_timeout"), F.lit(False))
        denied = ~timeout & (F.col("error").isNotNull() | (F.col("status") >= 400))
        asked = probes.where("tier <> 'baseline'").groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("_asked"), F.count_if(F.coalesce(denied, F.lit(False))).cast("int").alias("_denied"))
    rows = results.join(homes, "site", "left").join(asked, "site", "left").fillna({"_asked": 0, "_denied": 0})
    own = F.coalesce((F.col("check_id") == "cr.access.http_error") & (F.col("status") == "fail") & F.col("_refused"), F.lit(False))
    reason = F.when(F.col("_asked") == 0, "crawler_access_unknown").when(F.col("_denied") == 0, "audit_user_agent_refused").when(F.col("_denied") < F.col("_asked"), "crawler_access_mixed")
    told = F.when(F.col("_asked") > 0, E.items(E.item("computed", F.concat(F.lit("crawlers_asked="), F.col("_asked"), F.lit("; refused="), F.col("_denied")), page="site"))).otherwise(E.none())
    return rows.withColumns({"status": F.when(own & reason.isNotNull(), "inconclusive").otherwise(F.col("status")), "reason": F.when(own, reason).otherwise(F.col("reason")),
                             "evidence": F.when(own, F.concat("evidence", told)).otherwise(F.col("evidence"))}).drop("_refused", "_asked", "_denied")


def sitemap_checks(sitemaps: DataFrame) -> DataFrame:
    """sitemaps: site, state (ok, missing, invalid, unreachable, challenge)."""
    open_ = F.col("state").isin("unreachable", "challenge")
    of = lambda bad: F.when(F.col("state") == bad, "fail").when(open_, "inconclusive").otherwise("pass")
    why = F.when(open_, F.concat(F.lit("sitemap_"), F.col("state")))
    seen = E.items(E.item("computed", F.concat(F.lit("state="), F.col("state")), page="sitemap"))
    return _rows(sitemaps, "cr.index.sitemap_missing", of("missing"), why, evidence=seen).unionByName(_rows(sitemaps, "cr.index.sitemap_invalid", of("invalid"), why, evidence=seen))


def link_checks(links: DataFrame) -> DataFrame:
    """links: site, url, status, error, challenge, skipped (null: fetched). Broken is 404, 410 or 5xx; three refusals of one host are the fetcher's trouble."""
    judged = links.where(F.col("skipped").isNull())
    refused = F.col("status").isin(403, 429) | F.coalesce("challenge", F.lit(False))
    broken = F.coalesce(F.col("status").isin(404, 410) | (F.col("status") >= 500), F.lit(False)) & ~F.coalesce("challenge", F.lit(False))
    failed = F.coalesce(F.col("error").isin(*V.TRANSPORT_ERRORS), F.lit(False))
    answer = F.struct(F.col("url"), F.coalesce(F.col("error"), F.col("status").cast("string")).alias("got"))
    told = lambda c: F.transform(F.slice(F.array_sort(F.col(c)), 1, 8), lambda a: E.item("http_status", F.concat(F.lit("GET "), a["url"], F.lit(" -> "), a["got"]), page="site"))
    clusters = judged.where(refused).groupBy("site", host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min(answer).alias("first")).where(F.col("n") >= V.BLOCKED_CLUSTER_MIN)
    blocked = links.select("site").distinct().join(clusters.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("host")), ",").alias("hosts"), F.collect_list("first").alias("refused")), "site", "left")
    agg = judged.groupBy("site").agg(F.count_if(broken).alias("broken"), F.count_if(failed).alias("failed"), F.array_sort(F.collect_set(F.when(broken, F.col("status")))).alias("statuses"),
                                     F.collect_list(F.when(broken, answer)).alias("bad"), F.collect_list(F.when(failed, answer)).alias("gone"))
    count = lambda c, text: E.items(E.item("computed", F.concat(F.lit(text), F.col(c)), page="site"))
    listed = E.items(E.item("computed", F.concat(F.lit("broken="), F.array_join(F.transform(F.array_sort("bad"), lambda a: F.replace(a["url"], F.lit(","), F.lit("%2C"))), ",")), page="site"))
    return (_rows(agg, "en.links.broken_sampled", F.when(F.col("broken") > 0, "fail").when(F.col("failed") > 0, "inconclusive").otherwise("pass"), F.when((F.col("broken") == 0) & (F.col("failed") > 0), "fetcher_error"), F.array_join("statuses", ","),
                  F.when(F.col("broken") > 0, F.concat(told("bad"), listed)).otherwise(F.concat(told("gone"), count("failed", "fetcher_errors="))))
            .unionByName(_rows(blocked, "en.links.blocked_cluster", F.when(F.col("hosts").isNotNull(), "inconclusive").otherwise("pass"), F.when(F.col("hosts").isNotNull(), "fetcher_blocked"), F.col("hosts"),
                               F.coalesce(told("refused"), E.none()))))


def missing_page_checks(probes: DataFrame) -> DataFrame:
    """probes: the answer to a random path, parsed: site, status, is_html and the document's columns; site's home as home_url."""
    soft = (F.col("status") == 200) & F.col("is_html")
    real = F.col("status").isin(404, 410)
    to_home = F.exists("links", lambda x: (canonical_key(x["url"]) == canonical_key(F.col("home_url"))))
    helpful = to_home | nav_landmark() | site_search()
    return (_rows(probes, "en.errors.soft_404", F.when(soft, "fail").when(real, "pass").otherwise("not_evaluated"), F.when(~soft & ~real, "probe_failed"),
                  evidence=E.items(E.item("http_status", "GET a random path -> 200", page="site"), E.item("html_excerpt", F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit("</title>")), page="site", location="head > title")))
            .unionByName(_rows(probes, "en.errors.unhelpful_404", F.when(soft, "not_evaluated").when(real & helpful, "pass").when(real, "fail").otherwise("not_evaluated"),
                               F.when(soft, "soft_404").when(~real, "probe_failed"), evidence=E.items(
                                   E.item("http_status", F.concat(F.lit("GET a random path -> "), F.col("status")), page="site"), E.item("computed", "home_link=false; nav_landmark=false; search=false", page="site")))))


def entity_checks(lookups: DataFrame) -> DataFrame:
    """lookups: entities.lookup_outcome(). A lookup that could not run is itself a finding, and leaves the two verdicts open."""
    rows = lookups.withColumns({c: F.lit(None).cast("string") for c in ("mode", "target", "reason") if c not in lookups.columns})
    gone, skipped = F.col("outcome") == "unavailable", F.col("outcome") == "skipped"
    seen = E.items(E.item("external", F.coalesce("target", F.lit("-")), page="site", note=F.concat(F.lit("outcome="), F.col("outcome"), F.coalesce(F.concat(F.lit(" reason="), F.col("reason")), F.lit("")))))
    of = lambda *bad: F.when(gone | skipped, "not_evaluated").when(F.col("outcome").isin(*bad), "fail").otherwise("pass")
    why = F.when(gone, "lookup_unavailable").when(skipped, F.coalesce("reason", F.lit("no_brand_name")))
    sure = F.when((F.col("outcome") == "not_found") & F.coalesce(F.col("mode").startswith("verify"), F.lit(False)), "medium")
    own = F.when(gone | skipped, F.coalesce("reason", F.when(gone, "lookup_failed").otherwise("no_brand_name")))
    return (_rows(rows, "ef.entity.wikidata_ambiguous", of("ambiguous", "collision", "mismatch"), why, evidence=seen)
            .unionByName(_rows(rows, "ef.entity.wikidata_not_found", of("not_found"), why, evidence=seen).withColumn("confidence", sure))
            .unionByName(_rows(rows, "ef.entity.wikidata_unavailable", F.when(gone | skipped, "not_evaluated").otherwise("pass"), own, F.when(gone, "told"), seen)))


def offsite_checks(sites: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """mentions: site, kind. Informational: counts by kind where mentions were recorded."""
    if mentions is None:
        return _rows(sites, "ef.corroboration.offsite_spotcheck", F.lit("not_evaluated"), F.lit("tool_unavailable"))
    kinds = mentions.groupBy("site", "kind").count().groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "count"))), ",").alias("kinds"))
    there = F.col("kinds").isNotNull()
    return _rows(sites.select("site").join(kinds, "site", "left"), "ef.corroboration.offsite_spotcheck", F.when(there, "inconclusive").otherwise("not_evaluated"),
                 F.when(there, "bounded_spotcheck").otherwise("tool_unavailable"), F.col("kinds"), E.items(E.item("computed", F.concat(F.lit("mentions: "), F.col("kinds")), page="site")))


def fact_check(facts: DataFrame) -> DataFrame:
    """One missing fact is medium, more are high: the detail lists them."""
    agg = facts.where("required").groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("status") != "present", F.col("fact_id")))).alias("missing"))
    return _rows(agg, "fx.facts.key_fact_missing", F.when(F.size("missing") > 0, "fail").otherwise("pass"), None, F.array_join("missing", ","),
                 E.items(E.item("computed", F.concat(F.lit("key_facts="), F.col("n"), F.lit("; missing="), F.array_join("missing", ",")), page="site")))


def name_checks(pages: DataFrame, brands: DataFrame) -> DataFrame:
    """Name and locator facts in the visible text of home, contact and about; names that contradict each other. brands: site, brand, source."""
    shown = pages.where(F.col("excluded").isNull() & F.col("role").isin("home", "contact", "about")).join(brands.select("site", "brand", "source"), "site", "left").groupBy("site", "category").agg(
        F.bool_or(F.lower("body_text").contains(F.lower("brand"))).alias("told"), F.first("source").alias("source"), F.bool_or(address_label(F.col("body_text")).isNotNull()).alias("address"),
        F.bool_or(text_phone(F.col("body_text")).isNotNull()).alias("phone"), F.bool_or(matches(F.col("body_text"), "email")).alias("email"))
    rows = shown
    named = (F.col("source") == "host") | F.col("told")
    located = (F.when(F.col("category") == "local_business", F.col("address") & F.col("phone")).when(F.col("category") == "portfolio_personal", F.col("email") | F.col("phone"))
               .when(F.col("category") == "unknown", F.col("address") | F.col("phone") | F.col("email")).otherwise(F.col("address") | F.col("phone")))
    gaps = F.array_join(F.filter(F.array(F.when(~named, "name"), F.when(~F.col("address"), "address"), F.when(~F.col("phone"), "phone")), lambda x: x.isNotNull()), ",")
    nap = _rows(rows, "ef.entity.nap_missing_plain_text", F.when(F.coalesce(named & located, F.lit(False)), "pass").otherwise("fail"), None, gaps, E.items(E.item("computed", F.concat(F.lit("missing="), F.when(gaps == "", "none").otherwise(gaps)), page="site")))
    apart = entities.conflicts(entities.name_candidates(pages.where("excluded is null")))
    found = pages.select("site").distinct().join(apart, "site", "left")
    told = F.transform("names", lambda n: E.item("computed", n["name"], page=F.coalesce(n["page"], F.lit("site")), note=n["source"]))
    pair = F.array_join(F.transform("names", lambda n: n["name"]), " / ")
    return nap.unionByName(_rows(found, "ef.entity.name_inconsistent", F.when(F.col("names").isNotNull(), "fail").otherwise("pass"), None, pair, told))


def trust_checks(pages: DataFrame, detected: DataFrame) -> DataFrame:
    """The trust signals that a category's visitors expect, on home, about and contact. detected: facts.detect() over the same pages."""
    text = F.col("body_text")
    link = lambda n: F.exists("links", lambda x: ~x["in_head"] & (matches(x["text"], n) | matches(path(x["url"]), n)))
    heading = lambda n: F.exists("headings", lambda h: matches(h["text"], n))
    image = lambda n: F.exists("images", lambda i: matches(F.concat_ws(" ", i["alt"], F.element_at(F.split(i["src"], "/"), -1)), n))
    people = heading("team") | link("team") | matches(text, "leadership")
    signals = {
        "terms_privacy_links": link("terms_privacy"), "returns_policy_link": link("returns"), "payment_or_security_badge": image("badge") | matches(text, "badge"),
        "review_markup_or_count": (F.size(typed(("AggregateRating", "Review"), top=False)) > 0) | matches(text, "review"), "premises_photos": image("premises_img"),
        "testimonials_or_logos": F.exists("quotes", lambda q: q["words"] >= 8) | heading("testimonial") | matches(text, "testimonial"), "security_or_compliance_link": link("security"),
        "team_named_people": people, "named_people": people, "clients_or_case_studies": heading("clients") | link("clients"), "credentials": matches(text, "credentials"),
        "registration_number": matches(text, "reg_number"), "financial_report_link": link("financial") | matches(text, "financial"), "named_leadership": matches(text, "leadership") | heading("team"),
    }
    listed = F.array(*[F.when(v, F.lit(k)) for k, v in signals.items()])
    own = pages.where(F.col("excluded").isNull() & F.col("role").isin("home", "about", "contact")).select("site", "category", F.explode(listed).alias("signal")).where("signal is not null").distinct()
    facts = detected.where("value is not null").select("site", F.when(F.col("detector") == "hours", "opening_hours").when(F.col("detector") == "price", "pricing_transparency").otherwise(F.col("detector")).alias("signal"))
    every = own.select("site", "signal").unionByName(facts.where(F.col("signal").isin("opening_hours", "pricing_transparency", "address", "phone"))).distinct()
    spark = pages.sparkSession
    listed_categories = list(V.TRUST_SIGNALS)
    sites = pages.where(F.col("excluded").isNull() & F.col("role").isin("home", "about", "contact")).select("site", "category").distinct().withColumn(
        "key", F.when(F.col("category").isin(*listed_categories), F.col("category")).otherwise("*"))
    expected = sites.join(F.broadcast(dim(spark, "trust_signal").withColumnRenamed("category", "key")), "key").join(every.withColumn("there", F.lit(True)), ["site", "signal"], "left")
    judged = expected.groupBy("site").agg(F.bool_and(F.when(F.col("kind") == "required", F.col("there").isNotNull())).alias("required"), F.bool_or(F.when(F.col("kind") == "any_of", F.col("there").isNotNull())).alias("some"),
                                          F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("signal")))), ",").alias("missing"))
    return _rows(judged, "en.trust.signals_missing", F.when(F.coalesce("required", F.lit(True)) & F.col("some"), "pass").otherwise("fail"), None, F.col("missing"), E.items(E.item("computed", F.concat(F.lit("missing="), F.col("missing")), page="site")))


def same_host(a: Column, b: Column) -> Column:
    return same_site(host(a), host(b))
