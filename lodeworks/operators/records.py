"""Record builders: a declarative map of fields, compiled to plain selects.

A builder is a list of ``FieldRule``: the name of a field, the places it may come from (first
filled one wins; a place the table lacks counts as empty), the rule that normalises it and its
default. Fields that are told from finished fields (``derived``) follow in a second select.
Everything is row-wise built-in expressions, so a builder adds no shuffle and no scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions import normalize as N
from lodeworks.functions import text as X
from lodeworks.functions.exprs import (
    STRINGS,
    any_of,
    contains_any,
    first_hit,
    has_items,
    is_filled,
    lookup,
    nonempty,
    nonzero,
    positive_int,
    strip,
    title_case,
    trimmed,
)
from lodeworks.functions.web import normalize_url, prefixed_url, site_root

PEOPLE = "array<struct<name:string,title:string>>"
CONTACTS = "array<struct<name:string,title:string,email:string,phone:string,linkedin:string,confidence:string>>"

# Fixed values of the record format.
REGION, COUNTRY = "North America", "US"
FORM_ASSETS = ("TtlRgltrAst", "TotalRegulatoryAssets", "RgltrAst", "AUM", "TtlAst", "TtlBillableAst")
FUND_FLAG = "Q7A16"
SMALL_ADVISER = 5_000_000


@dataclass(frozen=True)
class FieldRule:
    """One field of a record: ``sources`` are paths or columns, ``kind`` the type of an absent one."""

    name: str
    sources: Sequence[str | Column] = ()
    rule: Callable[[Column], Column] | None = None
    default: object = None
    kind: str = "string"


def has_path(schema: T.DataType, path: str) -> bool:
    """Whether a dotted path leads to a field of a table."""
    for part in path.split("."):
        if not isinstance(schema, T.StructType) or part not in schema.names:
            return False
        schema = schema[part].dataType
    return True


def source(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A field by its path, a typed null where the table lacks it."""
    return F.col(path) if has_path(df.schema, path) else F.lit(None).cast(kind)


def compiled(df: DataFrame, rule: FieldRule) -> Column:
    found = [source(df, s, rule.kind) if isinstance(s, str) else s for s in rule.sources]
    found = [nonempty(c) if rule.kind == "string" else c for c in found]
    value = F.coalesce(*found) if found else F.lit(None).cast(rule.kind)
    value = rule.rule(value) if rule.rule else value
    if rule.default is not None:
        default = rule.default if isinstance(rule.default, Column) else F.lit(rule.default)
        value = F.coalesce(value, default)
    return value.alias(rule.name)


def build(
    df: DataFrame,
    rules: Sequence[FieldRule],
    derived: Mapping[str, Column] | None = None,
    order: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The record of each row: ``keep`` columns, the fields of ``rules``, then ``derived`` ones."""
    out = df.select(*keep, *[compiled(df, r) for r in rules])
    if derived:
        out = out.withColumns(dict(derived))
    return out.select(*keep, *order) if order else out


def empty_list(kind: str = STRINGS) -> Column:
    return F.array().cast(kind)


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@dataclass(frozen=True)
class TypeRule:
    """A step of a type cascade: holds if a flag is set, or a word stands in the name or text.

    ``gate`` is a flag without which words do not count.
    """

    label: str
    flags: Sequence[str] = ()
    name_words: Sequence[str] = ()
    text_words: Sequence[str] = ()
    gate: str | None = None


def type_cascade(
    rules: Sequence[TypeRule], default: str, flags: Mapping[str, Column], name: Column, text: Column | None = None
) -> Column:
    """Label of the first rule that holds; unknown flags are off, nulls hold nothing."""
    low_name = F.lower(F.coalesce(name, F.lit("")))
    low_text = low_name if text is None else F.lower(F.coalesce(text, F.lit("")))

    def flag(key: str) -> Column:
        return F.coalesce(flags[key], F.lit(False)) if key in flags else F.lit(False)

    steps = []
    for r in rules:
        words = contains_any(low_name, r.name_words) | contains_any(low_text, r.text_words)
        if r.gate:
            words = words & flag(r.gate)
        if r.gate and not (r.name_words or r.text_words):
            words = flag(r.gate)
        steps.append((any_of(flag(f) for f in r.flags) | words, F.lit(r.label)))
    return F.coalesce(first_hit(steps), F.lit(default))


@dataclass(frozen=True)
class RecordRules:
    """Vocabularies of the builders; all are inputs."""

    sectors: Sequence[str] = ()
    sector_words: Mapping[str, Sequence[str]] = field(default_factory=dict)
    stage_words: Mapping[str, Sequence[str]] = field(default_factory=dict)
    focus_words: Sequence[str] = ()
    states: Sequence[str] = ()
    acronyms: Sequence[str] = ()
    types_by_name: Mapping[str, str] = field(default_factory=dict)
    types: Sequence[str] = ()
    default_type: str = "other"
    type_rules: Sequence[TypeRule] = ()
    weights: Mapping[str, int] = field(default_factory=dict)
    titles: Sequence[str] = ()
    portfolio_leads: Sequence[str] = ()
    founded_words: Sequence[str] = ("founded", "established", "since")
    regions: Sequence[tuple[str, str]] = ()
    state_of_geo: Mapping[str, str] = field(default_factory=dict)
    source_of_confidence: Mapping[str, str] = field(default_factory=dict)
    filing_url: str = "https://filings.example.com/{cik}"
    shown: int | None = None


def filing_link(cik: Column, template: str) -> Column:
    before, after = template.split("{cik}")
    return F.concat(F.lit(before), cik, F.lit(after))


def name_key(name: Column) -> Column:
    """The part of an identifier that stands in for a missing number."""
    return F.replace(F.replace(F.left(name, F.lit(25)), F.lit(" "), F.lit("_")), F.lit(","), F.lit(""))


def tagged(text: Column, rules: RecordRules) -> tuple[Column, Column, Column]:
    """Main sector, all sectors and stages of a text."""
    hits = X.class_hits(text, rules.sector_words)
    found = X.classes_by_hits(hits)
    every = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))
    return X.primary_class(hits), every, X.stage_tags(text, rules.stage_words)


CLEAN_ORDER = (
    "id name slug investor_type sector sectors stage focus region hq_country hq_state hq_city aum_usd aum_display "
    "check_size_min_usd check_size_max_usd check_size_display website sec_filing_url key_people contacts portfolio "
    "description founded_year sec_crd sec_file_num data_source data_confidence us_verified scraped_at completeness_score"
).split()


def clean_records(raw: DataFrame, rules: RecordRules, now: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The merged record of each raw row; rows without a name go. Lists may come as arrays or text."""

    def listed(path: str) -> Column:
        value = source(raw, path, STRINGS)
        is_text = has_path(raw.schema, path) and isinstance(raw.schema[path].dataType, T.StringType)
        return N.list_of(value) if is_text else N.trimmed_list(value)

    c = F.col
    fields = [
        FieldRule("name", ["name"], lambda v: N.display_case(strip(v), rules.acronyms)),
        FieldRule("_id", ["id"], trimmed),
        FieldRule("investor_type", ["investor_type"], lambda v: N.mapped_type(v, rules.types_by_name, rules.types, rules.default_type)),
        FieldRule("sector", ["sector"], lambda v: F.when(v.isin(*rules.sectors), v), "general"),
        FieldRule("_sectors", [listed("sectors")], kind=STRINGS),
        FieldRule("stage", [listed("stage")], kind=STRINGS),
        FieldRule("focus", [listed("focus")], kind=STRINGS),
        FieldRule("hq_state", ["hq_state"], lambda v: N.state(v, rules.states)),
        FieldRule("hq_city", ["hq_city"], N.city),
        FieldRule("aum_usd", [source(raw, "aum_usd").cast("string")], positive_int),
        FieldRule("check_size_min_usd", [source(raw, "check_size_min_usd").cast("string")], positive_int),
        FieldRule("check_size_max_usd", [source(raw, "check_size_max_usd").cast("string")], positive_int),
        FieldRule("website", ["website", "source_url"], normalize_url),
        FieldRule("sec_filing_url", ["sec_filing_url"]),
        FieldRule("key_people", ["key_people"], N.people, empty_list(PEOPLE), PEOPLE),
        FieldRule("contacts", ["contacts"], N.contacts, empty_list(CONTACTS), CONTACTS),
        FieldRule("portfolio", [listed("portfolio")], kind=STRINGS),
        FieldRule("description", ["description"], trimmed),
        FieldRule("founded_year", [source(raw, "founded_year").cast("string")], positive_int),
        FieldRule("sec_crd", [source(raw, "sec_crd").cast("string")], trimmed),
        FieldRule("sec_file_num", ["sec_file_num"], trimmed),
        FieldRule("data_source", ["data_source"], default="unknown"),
        FieldRule("data_confidence", ["data_confidence"], default="medium"),
        FieldRule("scraped_at", ["scraped_at"], default=now_text() if now is None else now),
    ]
    derived = {
        "id": F.coalesce("_id", N.stable_id(["name", "hq_state"])),
        "slug": N.slug("name"),
        "sectors": N.sectors("sector", "_sectors", rules.sectors),
        "region": F.lit(REGION),
        "hq_country": F.lit(COUNTRY),
        "us_verified": F.lit(True),
        "aum_display": N.money("aum_usd"),
        "check_size_display": N.money_range("check_size_min_usd", "check_size_max_usd"),
    }
    rows = build(raw, fields, derived, keep=keep).filter(is_filled("name"))
    return rows.withColumn("completeness_score", completeness(rows, rules.weights)).select(*keep, *CLEAN_ORDER)


def completeness(rows: DataFrame, weights: Mapping[str, int]) -> Column:
    """Weights of the fields that say something: not null, empty, zero or false, nor the default."""

    def filled(name: str) -> Column:
        kind = rows.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            return has_items(name)
        if isinstance(kind, T.StringType):
            return is_filled(name)
        if isinstance(kind, T.BooleanType):
            return F.col(name)
        return F.col(name).isNotNull() & (F.col(name) != 0)

    return N.weighted_completeness({k: filled(k) for k in weights}, weights)


FILING_ORDER = (
    "id name description investor_type sector sectors stage focus region hq_state hq_city hq_country us_verified website "
    "aum_usd fund_size_usd check_size_min_usd check_size_max_usd key_people portfolio founded_year sec_cik sec_crd "
    "sec_form_type sec_filing_url data_source data_confidence scraped_at"
).split()


def filing_frame(rows: DataFrame, given: Mapping[str, Column], now: Column | None, keep: Sequence[str]) -> DataFrame:
    """Completes the fields that all filings share and puts them in order."""
    shared = {
        "description": F.lit(None).cast("string"),
        "focus": empty_list(),
        "region": F.lit(REGION),
        "hq_country": F.lit(COUNTRY),
        "us_verified": F.lit(True),
        "fund_size_usd": F.lit(None).cast("bigint"),
        "check_size_min_usd": F.lit(None).cast("bigint"),
        "check_size_max_usd": F.lit(None).cast("bigint"),
        "key_people": empty_list(PEOPLE),
        "portfolio": empty_list(),
        "founded_year": F.lit(None).cast("bigint"),
        "website": F.lit(None).cast("string"),
        "sec_crd": F.lit(None).cast("string"),
        "sec_cik": F.lit(None).cast("string"),
        "scraped_at": now_text() if now is None else now,
    }
    return rows.withColumns({**{k: v for k, v in shared.items() if k not in rows.columns}, **given}).select(*keep, *FILING_ORDER)


def padded(value: Column, width: int = 10) -> Column:
    """Zeros before a number's text; a longer one stays whole."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def adviser_filings(
    filings: DataFrame, rules: RecordRules, now: Column | None = None, keep: Sequence[str] = (), funds: int = 10
) -> DataFrame:
    """Flat records of nested adviser filings; foreign, nameless and tiny ones go."""

    def at(path: str, kind: str = "string") -> Column:
        return source(filings, path, kind)

    part = "FormInfo.Part1A"
    plain = isinstance_of(filings, f"{part}.Item5F", T.StructType)
    if plain:
        assets = F.coalesce(*[positive_int(at(f"{part}.Item5F.{k}").cast("string")) for k in FORM_ASSETS])
    else:
        assets = positive_int(at(f"{part}.Item5F").cast("string"))

    def flags(path: str) -> dict[str, Column]:
        names = filings.select(path).schema[0].dataType.names if isinstance_of(filings, path, T.StructType) else []
        return {n: at(f"{path}.{n}") == "Y" for n in names}

    of_funds, of_clients = flags(f"{part}.Item8A"), flags(f"{part}.Item7A")
    fund_kind = F.coalesce(
        any_of(F.coalesce(c, F.lit(False)) for c in [*of_funds.values(), *[v for k, v in of_clients.items() if k == FUND_FLAG]]),
        F.lit(False),
    )
    web = f"{part}.Item1.WebAddrs"
    sites = [F.get(F.col(w), F.lit(0)) if isinstance_of(filings, w, T.ArrayType) else at(w)
             for w in (f"{web}.WebAddrs", f"{web}.WebAddr")] if not isinstance_of(filings, web, T.ArrayType) else [F.get(F.col(web), F.lit(0))]
    listed = [p for p in ("scheduleD.item7B", "scheduleD.Item7B", "ScheduleD.item7B", "ScheduleD.Item7B") if has_path(filings.schema, p)]
    names = empty_list()
    if listed:
        kinds = filings.select(listed[0]).schema[0].dataType.elementType.names
        keys = [k for k in ("FundName", "PrivFundNm") if k in kinds]
        shown = F.slice(F.coalesce(*[F.col(p) for p in listed]), 1, funds)
        names = F.filter(F.transform(shown, lambda f: F.coalesce(*[nonempty(f[k]) for k in keys])), is_filled)
        names = F.coalesce(names, empty_list())
    person = F.coalesce(nonempty(at(f"{part}.Item1.ContctNm")), nonempty(at(f"{part}.Item1.Q1F1Nm")))
    contact = F.array(F.struct(person.alias("name"), F.lit("Contact").alias("title")))
    all_flags = {**{f"8A.{k}": v for k, v in of_funds.items()}, **{f"7A.{k}": v for k, v in of_clients.items()}, "fund": fund_kind}
    rows = build(
        filings,
        [
            FieldRule("name", ["Info.BusNm", "Info.LegalNm"], trimmed),
            FieldRule("_country", ["MainAddr.Cntry"], lambda v: F.upper(strip(v))),
            FieldRule("hq_state", ["MainAddr.State"], lambda v: F.upper(strip(v)), ""),
            FieldRule("hq_city", ["MainAddr.City"], lambda v: title_case(strip(v)), ""),
            FieldRule("aum_usd", [assets], kind="bigint"),
            FieldRule("_fund_kind", [fund_kind], kind="boolean"),
            FieldRule("website", sites, normalize_url),
            FieldRule("sec_crd", [at("Info.FirmCrdNb").cast("string")], trimmed),
            FieldRule("sec_cik", [at("Info.SECNb").cast("string")], lambda v: padded(trimmed(v))),
            FieldRule("portfolio", [names], kind=STRINGS),
            FieldRule("key_people", [F.when(person.isNotNull(), contact)], default=empty_list(PEOPLE), kind=PEOPLE),
            FieldRule("investor_type", [type_cascade(rules.type_rules, rules.default_type, all_flags, F.coalesce(nonempty(at("Info.BusNm")), nonempty(at("Info.LegalNm"))))]),
        ],
        keep=keep,
    )
    tiny = ~F.col("_fund_kind") & F.coalesce(F.col("aum_usd") < SMALL_ADVISER, F.lit(False))
    home = F.col("hq_state").isin(*rules.states) & F.coalesce(F.col("_country").isin("US", "USA", "UNITED STATES"), F.lit(True))
    rows = rows.filter(F.col("name").isNotNull() & home & ~tiny)
    blob = F.concat_ws(" ", "name", F.array_join("portfolio", " "))
    main, every, _ = tagged(blob, rules)
    stages = X.stage_tags(F.concat_ws(" ", blob, "investor_type"), rules.stage_words)
    given = {
        "id": F.concat(F.lit("sec_"), F.coalesce("sec_cik", "sec_crd", name_key(F.col("name")))),
        "sector": main,
        "sectors": every,
        "stage": stages,
        "sec_form_type": F.lit("ADV"),
        "sec_filing_url": filing_link(F.col("sec_cik"), rules.filing_url),
        "data_source": F.lit("sec_api"),
        "data_confidence": F.lit("high"),
    }
    return filing_frame(rows, given, now, keep)


def isinstance_of(df: DataFrame, path: str, kind: type) -> bool:
    return has_path(df.schema, path) and isinstance(df.select(path).schema[0].dataType, kind)


def offering_filings(
    filings: DataFrame, rules: RecordRules, now: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Flat records of nested offering filings; nameless and foreign issuers go."""
    rows = build(
        filings,
        [
            FieldRule("name", ["issuerInfo.issuerName"], trimmed),
            FieldRule("hq_state", ["issuerInfo.issuerAddress.stateOrCountry"], lambda v: F.upper(strip(v)), ""),
            FieldRule("hq_city", ["issuerInfo.issuerAddress.city"], lambda v: title_case(strip(v)), ""),
            FieldRule("aum_usd", [source(filings, "offeringData.totalOfferingAmount").cast("string")], positive_int),
            FieldRule("sec_cik", [source(filings, "cik").cast("string"), source(filings, "CIK").cast("string")], lambda v: padded(strip(v))),
        ],
        keep=keep,
    ).filter(F.col("name").isNotNull() & F.col("hq_state").isin(*rules.states))
    main, every, stages = tagged(F.col("name"), rules)
    given = {
        "id": F.concat(F.lit("sec_d_"), F.coalesce("sec_cik", name_key(F.col("name")))),
        "fund_size_usd": F.col("aum_usd"),
        "investor_type": type_cascade(rules.type_rules, rules.default_type, {}, F.col("name")),
        "sector": main,
        "sectors": every,
        "stage": stages,
        "sec_form_type": F.lit("D"),
        "sec_filing_url": filing_link(F.col("sec_cik"), rules.filing_url),
        "data_source": F.lit("sec_api"),
        "data_confidence": F.lit("medium"),
    }
    return filing_frame(rows, given, now, keep)


BULK_ORDER = [n for n in FILING_ORDER if n != "sec_cik"]
BULK_ORDER.insert(BULK_ORDER.index("sec_form_type"), "sec_file_num")


def bulk_records(
    rows: DataFrame, rules: RecordRules, flags: Mapping[str, Column] | None = None, now: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Records of the bulk table: ``crd, sec_nb, name, website, aum_usd, state`` and sector labels.

    ``flags`` are the columns the type cascade reads, by the names its rules use.
    """
    number = source(rows, "sec_nb")
    built = build(
        rows,
        [
            FieldRule("sec_crd", [source(rows, "crd").cast("string")]),
            FieldRule("sec_file_num", [number], default=""),
            FieldRule("_cik", [F.when(number.contains("-"), F.element_at(F.split(number, "-"), -1))], lambda v: padded(strip(v))),
            FieldRule("name", ["name"], title_case),
            FieldRule("investor_type", [type_cascade(rules.type_rules, rules.default_type, flags or {}, source(rows, "name"))]),
            FieldRule("stage", [X.stage_tags(source(rows, "name"), rules.stage_words)], kind=STRINGS),
            FieldRule("sector", ["sector"], default="general"),
            FieldRule("_sectors", ["sectors"], kind=STRINGS),
            FieldRule("website", ["website"], prefixed_url),
            FieldRule("aum_usd", [source(rows, "aum_usd").cast("string")], positive_int),
            FieldRule("hq_state", ["state"], default=""),
        ],
        keep=keep,
    )
    given = {
        "id": F.concat(F.lit("adv_"), "sec_crd"),
        "sectors": F.when(F.coalesce(F.size("_sectors") > 0, F.lit(False)), F.col("_sectors")).otherwise(F.array("sector")),
        "hq_city": F.lit(None).cast("string"),
        "sec_form_type": F.lit("ADV"),
        "sec_filing_url": filing_link(F.col("_cik"), rules.filing_url),
        "data_source": F.lit("sec_adv_bulk"),
        "data_confidence": F.lit("high"),
    }
    completed = built.withColumn("_number", F.col("sec_file_num"))
    framed = filing_frame(completed, given, now, [*keep, "_number"])
    return framed.withColumnRenamed("_number", "sec_file_num").select(*keep, *BULK_ORDER)


def profile_records(profiles: DataFrame, keep: Sequence[str] = (), nested: bool = False) -> DataFrame:
    """Flat profiles of nested ones, whose leaves may be wrapped as ``{value, confidence}``.

    ``nested`` keeps the whole nested profile as ``_profile``.
    """

    def leaf(path: str, kind: str = "string") -> Column:
        wrapped = f"{path}.value"
        return source(profiles, wrapped if has_path(profiles.schema, wrapped) else path, kind)

    def joined(path: str) -> Column:
        value = leaf(path, STRINGS)
        return nonempty(F.array_join(value, ", ")) if value_is_list(profiles, path) else value.cast("string")

    t1, t2 = "tier1", "tier2"
    low, high, single = (
        nonzero(source(profiles, f"{t1}.raise_amount_usd.{k}", "double")) for k in ("value_min", "value_max", "value")
    )
    need = F.when(low.isNotNull() & high.isNotNull(), F.concat(N.money_profile(low), F.lit("–"), N.money_profile(high)))
    need = F.coalesce(need, N.money_profile(single), source(profiles, f"{t1}.raise_amount_usd.note"))
    places = [nonempty(source(profiles, f"{t1}.geo.{k}")) for k in ("hq_city", "hq_state", "hq_country")]
    traction = f"{t2}.traction"
    missing = F.coalesce(source(profiles, "missing_signals", STRINGS), empty_list())
    columns = {
        "company_name": source(profiles, "company_name"),
        "tagline": source(profiles, "tagline"),
        "funding_stage": leaf(f"{t1}.funding_stage"),
        "capital_need": need,
        "sector": joined(f"{t1}.sector_tags"),
        "geography": nonempty(F.concat_ws(", ", *places)),
        "investor_type_preference": joined(f"{t1}.investor_type_preference"),
        "seeking_lead": leaf(f"{t1}.seeking_lead", "boolean"),
        "instrument": leaf(f"{t1}.instrument"),
        "business_model": joined(f"{t2}.business_model"),
        "customer_type": leaf(f"{t2}.customer_type"),
        "arr_usd": source(profiles, f"{traction}.arr_usd", "double"),
        "mrr_usd": source(profiles, f"{traction}.mrr_usd", "double"),
        "paying_customers": source(profiles, f"{traction}.paying_customers", "bigint"),
        "pre_revenue": F.coalesce(source(profiles, f"{traction}.pre_revenue", "boolean"), F.lit(False)),
        "key_traction": source(profiles, f"{traction}.note"),
        "team_background": joined(f"{t2}.team_background"),
        "use_of_funds": leaf(f"{t2}.use_of_funds"),
        "sub_sector_tags": joined(f"{t2}.sub_sector_tags"),
        "narrative_text": source(profiles, "tier3.narrative_text"),
        "overall_confidence": F.coalesce(source(profiles, "overall_confidence", "double"), F.lit(0.0)),
        "missing_signals": missing,
    }
    if nested:
        columns["_profile"] = F.struct(*[c for c in profiles.columns if c not in keep])
    return profiles.select(*keep, *[v.alias(k) for k, v in columns.items()])


def value_is_list(df: DataFrame, path: str) -> bool:
    wrapped = f"{path}.value"
    at = wrapped if has_path(df.schema, wrapped) else path
    return not has_path(df.schema, at) or isinstance(df.select(at).schema[0].dataType, T.ArrayType)


def browse_records(firms: DataFrame, rules: RecordRules, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of the browsing list, told from scored firm records.

    ``rules.shown`` cuts the description; by default it is whole.
    """

    def at(path: str, kind: str = "string") -> Column:
        return source(firms, path, kind)

    thesis = nonempty(at("thesis_text"))
    geo = F.coalesce(at("geo_focus", STRINGS), empty_list())
    sectors = F.coalesce(at("sectors", STRINGS), empty_list())
    named = F.filter(at("partner_contacts", PEOPLE), lambda p: is_filled(p["name"]))
    people = F.transform(named, lambda p: F.struct(p["name"].alias("name"), p["title"].alias("title")))
    companies = F.filter(
        F.transform(at("portfolio_companies", "array<struct<name:string>>"), lambda p: p["name"]), is_filled
    )
    columns = {
        "name": F.coalesce(nonempty(at("display_name")), at("name")),
        "website": at("official_website"),
        "type": at("investor_type"),
        "hq_state": lookup(dict(rules.state_of_geo), F.get(geo, F.lit(0))),
        "data_source": F.coalesce(lookup(dict(rules.source_of_confidence), at("overall_confidence")), F.lit("unverified")),
        "stages": at("stages", STRINGS),
        "sectors": sectors,
        "sector": F.get(sectors, F.lit(0)),
        "geo_focus": geo,
        "lead_investor": at("lead_investor"),
        "check_size": at("check_size_display"),
        "check_size_min_usd": at("check_size_min_usd", "bigint"),
        "check_size_max_usd": at("check_size_max_usd", "bigint"),
        "description": thesis if rules.shown is None else F.left(thesis, F.lit(rules.shown)),
        "key_people": F.when(F.size(people) > 0, people),
        "portfolio": F.when(F.size(companies) > 0, companies),
        "completeness_score": F.coalesce(at("tier1_completeness", "bigint"), F.lit(0)),
        "tier2_completeness": F.coalesce(at("tier2_completeness", "bigint"), F.lit(0)),
        "contacts_completeness": F.coalesce(at("contacts_completeness", "bigint"), F.lit(0)),
        "submission_url": at("submission_url"),
        "general_email": at("general_email"),
    }
    return firms.select(*keep, *[v.alias(k) for k, v in columns.items()])


def page_records(
    pages: DataFrame,
    rules: RecordRules,
    name: Column,
    sector: Column | None = None,
    this_year: int = 2026,
    now: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Records of search results (``url, title, text``); pages whose ``name`` is null go.

    Stage, region and focus are read from text and title, people and portfolio from the text.
    """
    body = F.coalesce("text", F.lit(""))
    whole = F.concat(body, F.lit(" "), F.coalesce("title", F.lit("")))
    low = F.lower(whole)
    focus = F.sort_array(F.array_compact(F.array(*[F.when(low.contains(w.lower()), w) for w in rules.focus_words])))
    columns = {
        "name": name,
        "description": X.lead_description(body),
        "stage": F.get(X.stage_tags(whole, rules.stage_words, default=None), F.lit(0)),
        "region": X.first_listed(whole, rules.regions),
        "focus": focus if rules.focus_words else empty_list(),
        "sector": F.lit(None).cast("string") if sector is None else sector,
        "key_people": X.people_from_text(body, rules.titles) if rules.titles else empty_list(PEOPLE),
        "portfolio": X.listed_portfolio(body, rules.portfolio_leads) if rules.portfolio_leads else empty_list(),
        "founded_year": X.founded_year(whole, rules.founded_words, this_year, first_only=True),
        "website": F.coalesce(nonempty(site_root("url")), F.col("url")),
        "source_url": F.col("url"),
        "scraped_at": now_text() if now is None else now,
    }
    return pages.select(*keep, *[v.alias(k) for k, v in columns.items()]).filter(is_filled("name"))
