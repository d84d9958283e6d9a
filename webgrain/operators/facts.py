"""Key facts of a site, each the first hit in order of preference over its pages.

Every page proposes candidates for all facts in one projection; one aggregation by site and fact takes the first by (pass, role
preference, page, place in the page). The guard against navigation text is applied to the one that was taken: a rejected first hit
is no fact, it does not make way for the next.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions import vocab as V
from webgrain.functions.dims import dim
from webgrain.functions.extend import REGISTERED
from webgrain.functions.text import all_matches, around, clip, excerpt, first_match, first_span, guarded, let, looks_like_prose, matches, usable_value, window, words
from webgrain.functions.url import host, without_www

TEXT_MOST = 400_000
#: Keys whose strings in structured data count as a page's text; types that name an offer.
TEXT_KEYS = ("description", "name", "slogan", "jobTitle", "priceRange", "openingHours", "telephone", "email", "streetAddress", "addressLocality",
             "addressRegion", "postalCode", "addressCountry", "audience", "areaServed", "knowsAbout")
OFFER_TYPES = ("Product", "Service", "Menu", "MenuItem", "ItemList", "Offer", "Course", "Event")
MISSION_TYPES = ("NGO", "EducationalOrganization", "GovernmentOrganization", "Organization")
ORG_TYPES = tuple(dict.fromkeys((
    *V.LOCAL_BUSINESS_TYPES, "Organization", "Corporation", "NGO", "EducationalOrganization", "CollegeOrUniversity", "School", "HighSchool", "ElementarySchool", "MiddleSchool", "Preschool",
    "GovernmentOrganization", "NewsMediaOrganization", "MedicalOrganization", "SportsOrganization", "SportsTeam", "PerformingGroup", "MusicGroup", "Airline", "Consortium", "LibrarySystem",
    "OnlineBusiness", "OnlineStore", "ResearchOrganization", "WorkersUnion", "FundingScheme", "FundingAgency", "Cooperative", "Project", "Church", "PlaceOfWorship", "Hospital", "Consultant",
    "MarketingAgency", "DesignAgency", "Brand")))
_SPAN = "struct<start:int,stop:int,m:string>"
#: Fixed value: how far before a number a cue word may stand.
CUE_REACH = 30


def value_of(json: Column, key: str) -> Column:
    """A key of structured data as text, null when empty."""
    return F.nullif(F.get_json_object(json, f"$.{key}"), F.lit(""))


def text_of(json: Column, key: str) -> Column:
    """The same where it is no object or list."""
    v = value_of(json, key)
    return F.when(~v.rlike(r"^[\[{]"), v)


def typed(types: tuple[str, ...], top: bool = True) -> Column:
    """Nodes of a page with one of the types."""
    wanted = F.array(*map(F.lit, types))
    return F.filter("nodes", lambda n: F.arrays_overlap(n["types"], wanted) & (n["top"] | F.lit(not top)))


def first_of(nodes: Column, get) -> Column:
    """The first value that get finds in an array of nodes."""
    return F.get(F.filter(F.transform(nodes, lambda n: get(n["json"])), lambda v: v.isNotNull()), F.lit(0))


def anywhere(key: str) -> Column:
    return first_of(F.col("nodes"), lambda j: value_of(j, key))


def page_text() -> Column:
    leaves = F.transform(F.filter("leaves", lambda x: x["key"].isin(*TEXT_KEYS)), lambda x: x["value"])
    about = F.coalesce(F.nullif(F.try_element_at("meta", F.lit("description")), F.lit("")), F.try_element_at("meta", F.lit("og:description")))
    return F.substring(F.concat_ws(" \n ", "body_text", about, F.array_join(leaves, " \n ")), 1, TEXT_MOST)


def digits(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\D", ""))


def text_phone(text: Column) -> Column:
    """The first number of 9 to 15 digits that has a plus or a cue word right before it (in CUE_REACH characters); else of 8 to 15 in any grouping after a cue."""
    def announced(t: Column, s: Column) -> Column:
        return digits(s["m"]).between(9, 15) & (F.trim(s["m"]).startswith("+") | matches(window(t, s["start"] - CUE_REACH, s["start"]), "phone_cue"))

    loose = F.filter(all_matches(text, "phone_after_cue", 1), lambda m: digits(m).between(8, 15))
    return F.trim(F.coalesce(guarded(text, "phone_text", announced)["m"], F.get(loose, F.lit(0))))


def _word_before(t: Column, s: Column) -> Column:
    """A postcode without a word before it is more likely a product code."""
    return window(t, s["start"] - 40, s["start"]).rlike("[A-Za-z]{3,}")


def _place_beside(t: Column, s: Column) -> Column:
    """A postcode and a town need a word for an address nearby, or a country next to them."""
    return matches(window(t, s["start"] - 60, s["stop"] + 40), "address_cue") | matches(window(t, s["stop"], s["stop"] + 30), "country_after") | matches(window(t, s["start"] - 30, s["start"]), "country_before")


#: Address grammars in order, with the name that each reports and the guard that each match must pass.
ADDRESS_GRAMMARS = [("street", "street", None), ("street_reversed", "street", None), ("street_fr", "street", None), ("uk_postcode", "uk_postcode", _word_before), ("us_city_state_zip", "us_city_state_zip", None),
                    ("in_pin", "in_pin", None), ("eu_postcode_city", "eu_postcode_city", _place_beside), ("jp_postcode", "jp_postcode", None)]


def address_span(text: Column) -> Column:
    """struct(label, start, stop, m) of the first grammar that has a match which its guard lets pass, null for none. Every match is tried."""
    def named(label: str, span: Column) -> Column:
        return let(span, lambda s: F.when(s.isNotNull(), F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["stop"].alias("stop"), s["m"].alias("m"))))
    return F.coalesce(*[named(label, guarded(text, name, guard) if guard else first_span(text, name)) for name, label, guard in ADDRESS_GRAMMARS])


def address_label(text: Column) -> Column:
    """Which address grammar a text holds, null for none."""
    return address_span(text)["label"]


def address_excerpt(text: Column) -> Column:
    return around(text, address_span(text), 40, 30)


def _link(name: str) -> Column:
    return F.get(F.filter("links", lambda x: matches(x["text"], name)), F.lit(0))["text"]


def _button(name: str) -> Column:
    return F.get(F.filter("buttons", lambda x: matches(x["text"], name)), F.lit(0))["text"]


def _heading(name: str) -> Column:
    return F.get(F.filter("headings", lambda h: matches(h["text"], name) & ~h["context"].isin("header", "nav", "aside")), F.lit(0))["text"]


def _joined(values: Column, least: int = 3, most: int = 5) -> Column:
    return F.when(F.size(values) >= least, F.array_join(F.slice(values, 1, most), "; "))


def _h1() -> Column:
    return F.get(F.filter("headings", lambda h: h["tag"] == "h1"), F.lit(0))["text"]


def _title_parts() -> Column:
    return F.split(F.coalesce("title", F.lit("")), r"\s+[|—–-]\s+|\s*:\s+")


def _long(value: Column, least: int = 40) -> Column:
    return F.when(F.char_length(value) >= least, value)


class Window(NamedTuple):
    """A candidate that is the first match of a pattern in a column of text, with so many characters around it; detect() cuts all of them in one expression."""
    column: str
    pattern: str
    before: int
    after: int


def proposals() -> list[tuple[str, int, tuple[str, ...], int, str, Column | Window]]:
    """(detector, pass, preferred roles, place in the page, source, value) over a page row with `text` (page_text)."""
    text, body = F.col("text"), F.col("body_text")
    meta = lambda k: F.nullif(F.try_element_at("meta", F.lit(k)), F.lit(""))
    top = F.filter("nodes", lambda n: n["top"])
    org, person = typed(ORG_TYPES), typed(("Person",))
    words_in = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    postal = first_of(F.col("nodes"), lambda j: F.when(value_of(j, "streetAddress").isNotNull() | (value_of(j, "addressLocality").isNotNull() & value_of(j, "postalCode").isNotNull()),
                      F.concat_ws(", ", *[value_of(j, k) for k in ("streetAddress", "addressLocality", "postalCode", "addressCountry")])))
    locality = first_of(F.col("nodes"), lambda j: F.when(value_of(j, "addressLocality").isNotNull(), F.concat_ws(", ", *[value_of(j, k) for k in ("addressLocality", "addressRegion", "addressCountry")])))
    price = first_of(typed(("Offer", "AggregateOffer"), top=False), lambda j: F.when(F.coalesce(value_of(j, "price"), value_of(j, "lowPrice")).isNotNull(), F.concat_ws(
        " ", F.coalesce(value_of(j, "price"), value_of(j, "lowPrice")), value_of(j, "priceCurrency"))))
    names = F.filter(F.transform(typed(OFFER_TYPES, top=False), lambda n: text_of(n["json"], "name")), lambda v: v.isNotNull())
    generic = lambda t: F.greatest(*[F.lower(t).contains(g) for g in V.GENERIC_HEADINGS])
    sections = F.transform(F.filter("headings", lambda h: h["tag"].isin("h2", "h3") & (h["text"] != "") & ~h["context"].isin("header", "nav", "aside") & ~generic(h["text"]) & (words_in(h["text"]) <= 8)), lambda h: h["text"])
    items = F.transform(F.filter("links", lambda x: x["internal"] & ~x["in_head"] & x["context"].isin("main", "body", "article") & words_in(x["text"]).between(2, 10)), lambda x: x["text"])
    mail = F.get(F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:")), F.lit(0))["href"]
    tel = F.get(F.filter("links", lambda x: F.lower(x["href"]).startswith("tel:")), F.lit(0))["href"]
    phone_ld = first_of(top, lambda j: F.when(digits(value_of(j, "telephone")) >= 7, value_of(j, "telephone")))
    asks = lambda f: F.exists(f["inputs"], lambda i: F.concat_ws(" ", F.lower(i["name"]), F.lower(i["type"])).rlike("email|message"))
    form = F.get(F.filter("forms", lambda f: asks(f) | ((F.col("role") == "contact") & (F.size(f["inputs"]) > 0))), F.lit(0))
    profile = F.get(F.filter("links", lambda x: F.greatest(*[host(x["url"]).contains(h) for h in V.PROFILE_HOSTS])), F.lit(0))["url"]
    crowd = lambda j: F.coalesce(*[F.coalesce(text_of(j, f"{k}.name"), text_of(j, f"{k}[0].name"), text_of(j, k)) for k in ("founder", "founders", "employee", "member")])
    staff = first_of(top, lambda j: F.coalesce(F.concat(F.coalesce(text_of(j, "numberOfEmployees.value"), text_of(j, "numberOfEmployees.minValue"), text_of(j, "numberOfEmployees")), F.lit(" employees")), crowd(j)))
    questions = F.transform(F.filter("headings", lambda h: h["tag"].isin("h2", "h3", "h4") & F.rtrim(h["text"]).endswith("?")), lambda h: h["text"])
    h1, parts = _h1(), _title_parts()
    after_h1 = F.substring(F.expr("substring(body_text, locate(filter(headings, h -> h.tag = 'h1')[0].text, body_text) + char_length(filter(headings, h -> h.tag = 'h1')[0].text))"), 1, 400)
    ps = ("pricing", "product", "home")
    ch, cah, hap, ah, ha = ("contact", "home"), ("contact", "about", "home"), ("home", "about", "product"), ("about", "home"), ("home", "about")
    part = excerpt(text, "participate", 20, 60)
    found = [
        ("price", 0, ps, 0, "text", Window("text", "price", 30, 40)), ("price", 0, ps, 1, "jsonld:Offer.price", price),
        ("sales_led", 0, (), 0, "text", Window("text", "sales_led", 40, 100)), ("sales_led", 0, (), 1, "link", _link("sales_led")),
        ("free_trial", 0, (), 0, "text", Window("text", "free_trial", 30, 40)), ("free_tier", 0, (), 0, "text", Window("text", "free_tier", 30, 40)),
        ("email", 0, ch, 0, "link:mailto", F.substring_index(F.substring(mail, 8, 400), "?", 1)),
        ("email", 0, ch, 1, "text", let(first_match(text, "email"), lambda m: F.when(~F.lower(m).rlike(r"\.(png|jpg|svg|gif)$"), m))),
        ("phone", 0, ch, 0, "link:tel", F.substring(tel, 5, 60)), ("phone", 0, ch, 1, "jsonld:telephone", phone_ld), ("phone", 1, ch, 0, "text", text_phone(text)),
        ("form", 0, ("contact",), 0, "form", F.when(form.isNotNull(), F.concat(F.lit("contact form ("), F.size(form["inputs"]).cast("string"), F.lit(" fields)")))),
        ("address", 0, cah, 0, "jsonld:PostalAddress", postal), ("address", 0, cah, 1, "jsonld:address", _long(first_of(F.col("nodes"), lambda j: text_of(j, "address")), 11)),
        ("address", 1, cah, 0, "text", address_excerpt(body)),
        ("hours", 0, ("contact", "home", "product"), 0, "jsonld:openingHours", F.coalesce(first_of(F.col("nodes"), lambda j: text_of(j, "openingHours")), F.when(anywhere("openingHoursSpecification").isNotNull() | anywhere("openingHours").isNotNull(), F.lit("openingHoursSpecification")))),
        ("hours", 1, ("contact", "home", "product"), 0, "text", Window("body_text", "hours", 20, 40)),
        ("description", 0, hap, 0, "meta:description", _long(meta("description"))), ("description", 1, hap, 0, "meta:og:description", _long(meta("og:description"))),
        ("description", 1, hap, 1, "jsonld:description", first_of(top, lambda j: _long(text_of(j, "description")))),
        ("description", 2, hap, 0, "heading+text", F.when((words_in(h1) >= 3) & (words_in(after_h1) >= 12), F.concat(h1, F.lit(" — "), after_h1))),
        ("audience", 0, hap, 0, "jsonld:audience", first_of(F.col("nodes"), lambda j: F.coalesce(text_of(j, "audience.audienceType"), text_of(j, "audience.name"), text_of(j, "audience")))),
        ("audience", 1, hap, 0, "text", Window("text", "audience", 20, 30)),
        ("location", 0, ("about", "home", "contact"), 0, "jsonld:PostalAddress", locality), ("location", 0, ("about", "home", "contact"), 1, "jsonld:areaServed", first_of(F.col("nodes"), lambda j: text_of(j, "areaServed"))),
        ("location", 1, ("about", "home", "contact"), 0, "text", first_match(body, "location_phrase")),
        ("date", 0, (), 0, "html:time", F.get("times", F.lit(0))), ("date", 1, (), 0, "jsonld:date", first_of(top, lambda j: F.coalesce(text_of(j, "datePublished"), text_of(j, "dateModified")))),
        ("date", 2, (), 0, "text", F.coalesce(first_match(body, "iso_date"), first_match(body, "text_date"))),
        ("identity", 0, ha, 0, "jsonld:name", first_of(org, lambda j: text_of(j, "name"))), ("identity", 0, ha, 1, "meta:og:site_name", F.coalesce(meta("og:site_name"), meta("application-name"))),
        ("identity", 1, (), 0, "text:copyright", first_match(body, "copyright", 1)),
        ("person", 0, ha, 0, "jsonld:Person.name", first_of(person, lambda j: text_of(j, "name"))),
        ("person", 1, ha, 0, "heading:h1", F.coalesce(F.when(words_in(h1).between(2, 4) & matches(F.trim(h1), "name"), h1), F.when(words_in(h1) <= 12, F.nullif(F.regexp_extract(h1, r"(?U)^([A-Z][\w'’\-]+(?:\s+[A-Z][\w'’\-]+){1,2})\b", 1), F.lit(""))))),
        ("person", 1, ha, 1, "title", F.when(matches(F.trim(parts[0]), "name"), F.trim(parts[0]))),
        ("role", 0, ha, 0, "jsonld:Person.jobTitle", first_of(person, lambda j: text_of(j, "jobTitle"))), ("role", 1, ha, 0, "text", first_match(body, "role_statement")),
        ("role", 1, ha, 1, "title", F.when(words_in(F.get(parts, F.lit(1))) >= 2, F.get(parts, F.lit(1)))), ("role", 1, ha, 2, "heading:h1", F.when(words_in(h1) >= 4, h1)),
        ("profile", 0, (), 0, "jsonld:sameAs", first_of(F.col("nodes"), lambda j: F.when(value_of(j, "sameAs").contains("http"), F.array_join(F.slice(F.regexp_extract_all(value_of(j, "sameAs"), F.lit(r"https?://[^\"\s,\]]+"), F.lit(0)), 1, 3), ", ")))),
        ("profile", 0, (), 1, "link:profile", profile),
        ("mission", 0, ah, 0, "text", Window("text", "mission", 20, 60)), ("mission", 1, ha, 0, "jsonld:description", first_of(typed(MISSION_TYPES), lambda j: _long(text_of(j, "description")))),
        ("participation", 0, hap, 0, "heading", _heading("participate")), ("participation", 0, hap, 1, "link", _link("participate")), ("participation", 0, hap, 2, "button", _button("participate")),
        ("participation", 0, hap, 3, "text", F.when(looks_like_prose(part), part)),
        ("leadership", 0, ah, 0, "jsonld:leadership", staff), ("leadership", 0, ah, 1, "text", F.coalesce(excerpt(body, "leadership", 40, 40), excerpt(body, "size", 40, 40))),
        ("signup", 0, ("home", "pricing", "product"), 0, "text", Window("text", "signup", 20, 60)), ("signup", 0, ("home", "pricing", "product"), 1, "link", _link("signup")), ("signup", 0, ("home", "pricing", "product"), 2, "button", _button("signup")),
        ("press", 0, (), 0, "text:press_email", Window("text", "press_email", 0, 40)),
        ("press", 1, ("about", "contact", "blog", "home"), 0, "text", Window("text", "press", 20, 60)), ("press", 1, ("about", "contact", "blog", "home"), 1, "heading", _heading("press")), ("press", 1, ("about", "contact", "blog", "home"), 2, "link", _link("press")),
        ("policy", 0, ("product", "home", "contact"), 0, "text", Window("text", "shipping_returns", 20, 60)), ("policy", 0, ("product", "home", "contact"), 1, "heading", _heading("shipping_returns")), ("policy", 0, ("product", "home", "contact"), 2, "link", _link("shipping_returns")),
        ("differentiator", 0, hap, 0, "text", Window("text", "differentiator", 20, 60)),
        ("faq", 0, (), 0, "jsonld:FAQPage", F.when(F.size(typed(("FAQPage",), top=False)) > 0, F.lit("FAQPage JSON-LD"))), ("faq", 1, (), 0, "heading", _heading("faq_heading")), ("faq", 1, (), 1, "heading:questions", F.when(F.size(questions) >= 3, F.array_join(F.slice(questions, 1, 3), "; "))),
    ]
    for name, prefer in (("offers", ("product", "home", "contact")), ("services", ("product", "home", "about")), ("goods", ("product", "home")), ("topics", ("blog", "home"))):
        found += [(name, 0, prefer, 0, "jsonld", _joined(names)), (name, 1, prefer, 0, "heading", F.when(F.col("role").isin("product", "pricing", "services"), _joined(sections))),
                  (name, 2, prefer, 0, "link", F.when(F.col("role").isin("product", "blog"), _joined(items)))]
    return found


def detect(docs: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """docs: parsed pages with site, role, page_ord, url. (site, detector, value, page, source); a value of navigation text is null."""
    pages = docs.withColumn("text", page_text())
    rows, where = [], ("text", "body_text")
    added = [(name, *candidate) for name, f in REGISTERED.detectors.items() for candidate in f()]
    for name, group, prefer, sub, source, value in proposals() + added:
        if not only or name in only:
            pref = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, prefer)), F.col("role")), F.lit(0)), F.lit(99)) if prefer else F.lit(99)
            window = value if isinstance(value, Window) else None
            span = F.lit(None).cast(_SPAN) if window is None else first_span(F.col(window.column), window.pattern)
            rows.append(F.struct(F.lit(name).alias("detector"), F.lit(group).alias("pass"), pref.cast("int").alias("pref"), F.col("page_ord").cast("int").alias("page_ord"),
                                 F.lit(sub).alias("sub"), F.lit(source).alias("source"), (F.lit(None) if window else value).cast("string").alias("value"), span.alias("span"),
                                 *[F.lit(x).alias(c) for c, x in zip(("in", "before", "after"), (where.index(window.column), window.before, window.after) if window else (0, 0, 0), strict=True)]))
    found = F.filter(F.array(*rows), lambda c: c["value"].isNotNull() | c["span"].isNotNull())
    cut = F.transform(found, lambda c: c.withField("value", F.coalesce(c["value"], around(F.when(c["in"] == 0, F.col("text")).otherwise(F.col("body_text")), c["span"], c["before"], c["after"]))).dropFields("span", "in", "before", "after"))
    proposed = pages.select("site", "url", F.explode(cut).alias("c")).select("site", "url", "c.*")
    first = proposed.groupBy("site", "detector").agg(F.min_by(F.struct("value", F.col("url").alias("page"), "source"), F.struct("pass", "pref", "page_ord", "sub", "url")).alias("f"))
    return first.select("site", "detector", F.when(usable_value(F.col("f.value")), clip(F.col("f.value"))).alias("value"), "f.page", "f.source")


#: The detectors that state each fact, first found first.
FACT_DETECTORS = {
    "what_it_does": ("description",), "what_company_does": ("description",), "pricing_or_trial": ("price", "sales_led", "free_tier", "free_trial"),
    "sample_product_price": ("price",), "who_it_is_for": ("audience",), "who_it_serves": ("audience",), "contact_method": ("email", "phone", "form"),
    "contact_or_signup_method": ("email", "phone", "form", "signup"), "contact_or_press_method": ("press", "email", "phone", "form"),
    "contact_or_profile_link": ("email", "phone", "form", "profile"), "address": ("address",), "phone": ("phone",), "opening_hours": ("hours",),
    "services_or_menu": ("offers",), "services_offered": ("services",), "programs_or_services": ("services",), "what_it_sells": ("goods",), "topics_covered": ("topics",),
    "shipping_or_returns": ("policy",), "location_or_service_area": ("address", "location"), "location": ("address", "location"), "headquarters": ("address", "location"),
    "location_or_contact": ("address", "location", "email", "phone", "form"), "publisher_identity": ("identity",), "recency_evidence": ("date",), "who": ("person",),
    "what_they_do": ("role",), "mission": ("mission",), "how_to_participate": ("participation",), "leadership_or_size": ("leadership",), "audience": ("audience",),
    "differentiator": ("differentiator",),
}


def resolve(detected: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, fact_id, required, status, value, page, source) for the facts a site's category asks for and the optional two. sites: site, category.

    A free trial alone is a partial answer to the question of price.
    """
    spark = sites.sparkSession
    plan = F.broadcast(spark.createDataFrame([(f, i, d) for f, ds in (FACT_DETECTORS | {f: ds for f, (ds, _) in REGISTERED.facts.items()}).items() for i, d in enumerate(ds)], "fact_id string, n int, detector string"))
    needed = F.broadcast(dim(spark, "key_fact").select("category", "fact_id", F.lit(True).alias("required")))
    optional = sites.select("site", F.explode(F.array(F.lit("audience"), F.lit("differentiator"))).alias("fact_id"), F.lit(False).alias("required"))
    wanted = sites.select("site", F.coalesce("category", F.lit("unknown")).alias("category")).join(needed, "category").select("site", "fact_id", "required").unionByName(optional)
    met = wanted.join(plan, "fact_id").join(detected.where("value is not null"), ["site", "detector"]).groupBy("site", "fact_id").agg(
        F.min_by(F.struct("detector", "value", "page", "source"), "n").alias("f"))
    partial = (F.col("fact_id") == "pricing_or_trial") & (F.col("f.detector") == "free_trial")
    return wanted.join(met, ["site", "fact_id"], "left").select("site", "fact_id", "required", F.when(F.col("f").isNull(), "absent").when(partial, "partial").otherwise("present").alias("status"),
                                                                "f.value", "f.page", "f.source")


def brand(docs: DataFrame, detected: DataFrame) -> DataFrame:
    """(site, brand, source): the declared name, else a title segment of two pages, else the first label of the host."""
    segments = docs.select("site", "url", F.explode(_title_parts()).alias("raw")).select("site", "url", F.trim("raw").alias("segment")).where("segment <> ''").where(F.size(F.split("segment", r"\s+")) <= 4)
    common = segments.groupBy("site", "segment").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("site").agg(F.min_by("segment", F.struct(-F.col("n"), F.col("segment"))).alias("common"))
    declared = detected.where("detector = 'identity' and source not like 'text%'").select("site", F.col("value").alias("declared"), F.col("source").alias("declared_by"))
    sites = docs.select("site").distinct().join(declared, "site", "left").join(common, "site", "left")
    return sites.select("site", F.coalesce("declared", "common", F.initcap(F.substring_index(without_www(F.col("site")), ".", 1))).alias("brand"),
                        F.when(F.col("declared").isNotNull(), F.col("declared_by")).when(F.col("common").isNotNull(), "title:common_segment").otherwise("host").alias("source"))


def lead_words(text: Column, h1: Column, most: int = V.LEAD_WORDS) -> Column:
    """The first words of a text from the headline on, from the start where it is not in the text."""
    at = F.position(F.coalesce(h1, F.lit("")), text)
    return F.slice(words(F.substring(text, F.greatest(at, F.lit(1)), F.char_length(text))), 1, most)
