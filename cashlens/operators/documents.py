"""Report text jobs: lines, cash-flow rows, dividend evidence, share balances, document selection.

A document is one row.  Its lines live in an array, section state is found with small index arrays,
and only matching rows are exploded, so the text itself is never shuffled and no window runs over
lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.functions import text as X
from cashlens.functions.hashing import evidence_id
from cashlens.functions.numeric import let
from cashlens.operators.scale import join_null_safe, latest_by

c = F.col


def page_lines(page: Column) -> Column:
    """Lines of a page; a trailing line break adds no line."""
    return F.when(F.length(page) == 0, F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(page, r"\r?\n$", ""), r"\r?\n")
    )


def pages_of(docs: DataFrame, text: str = "text", offsets: bool = True) -> DataFrame:
    """One row per page with its number, lines and, with ``offsets``, global line offset; a map-side explode."""
    keep = [x for x in docs.columns if x != text]
    staged = docs.withColumn("_pages", F.split(c(text), "\f"))
    if not offsets:
        return staged.select(*keep, F.posexplode("_pages").alias("i", "page_text")).select(
            *keep, (c("i") + 1).alias("page"), "page_text", page_lines(c("page_text")).alias("lines")
        )
    staged = staged.withColumn("_sizes", F.transform("_pages", lambda p: F.size(page_lines(p))))
    starts = F.transform(
        "_sizes", lambda _, i: F.aggregate(F.slice(c("_sizes"), F.lit(1), i), F.lit(0), lambda a, x: a + x + 1)
    )
    return staged.select(*keep, F.posexplode(F.arrays_zip(c("_pages").alias("p"), starts.alias("o"))).alias("i", "z")).select(
        *keep, (c("i") + 1).alias("page"), c("z.p").alias("page_text"), page_lines(c("z.p")).alias("lines"), c("z.o").alias("line_offset")
    )


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with page, page line and global line number (all map-side)."""
    p = pages_of(docs, text)
    keep = [x for x in p.columns if x not in ("page_text", "lines", "line_offset")]
    return p.select(*keep, "line_offset", F.posexplode("lines").alias("j", "line")).select(
        *keep, (c("j") + 1).alias("page_line"), (c("line_offset") + c("j") + 1).alias("text_line"), "line"
    )


def is_statement_title(s: Column) -> Column:
    """A consolidated cash-flow title alone on its (compacted) line: numbering before, Latin title after."""
    body = "|".join(X.STATEMENT_TITLES)
    return s.rlike(r"^[0-9一二三四五六七八九十、.()]*(?:" + body + r")[a-z]*$") & ~X.any_of(s, X.TITLE_EXCLUSIONS)


def is_statement_end(s: Column) -> Column:
    """Another cash-flow statement or an equity statement begins on this (compacted) line."""
    other = s.rlike("现金流量表|現金流量表") & ~X.any_of(s, X.STATEMENT_TITLES)
    return other | X.any_of(s, X.STATEMENT_ENDS)


def statement_rows(
    docs: DataFrame,
    labels: Sequence[str],
    absolute: bool = False,
    wrapped: bool = False,
    title=is_statement_title,
    end=is_statement_end,
    other_labels: Sequence[str] = X.CFO_LABELS + X.CAPEX_LABELS + X.FIXED_ASSET_LABELS + X.INTANGIBLE_LABELS,
) -> DataFrame:
    """Labelled rows inside the active statement, with current and comparative amount and page unit.

    ``docs``: one row per document with text, currency, market.  Each document becomes an array of
    ``rows`` (empty when nothing matches); a wrapped row may span up to three lines.
    """
    squeezed = tuple(dict.fromkeys(x.replace(" ", "").lower() for x in labels))
    others = tuple(dict.fromkeys(x.replace(" ", "").lower() for x in other_labels))
    has_label = lambda s: X.any_of(X.compact(s), squeezed)
    pages = F.split(c("text"), "\f")
    staged = docs.withColumn("_pages", pages)
    flat = F.flatten(
        F.transform(
            "_pages",
            lambda p, i: let(
                page_lines(p),
                lambda ls: F.transform(
                    ls,
                    lambda x, j: F.struct(
                        (i + 1).alias("page"),
                        (j + 1).alias("page_line"),
                        x.alias("line"),
                        X.compact(x).alias("k"),
                        F.get(ls, j + 1).alias("next"),
                        F.get(ls, j + 2).alias("next2"),
                    ),
                ),
            ),
        )
    )
    staged = staged.withColumn(
        "_lines", F.transform(flat, lambda s, g: s.withField("g", g).withField("ti", title(s["k"])))
    ).drop("text")
    marks = staged.withColumns(
        {
            "_titles": F.transform(F.filter("_lines", lambda s: s["ti"]), lambda s: F.struct(s["g"], s["page"])),
            "_ends": F.transform(F.filter("_lines", lambda s: ~s["ti"] & end(s["k"])), lambda s: s["g"]),
        }
    )
    labelled = lambda s: X.any_of(s["k"], squeezed)
    starts = (lambda s: labelled(s) | _shares_prefix(s["k"], squeezed)) if wrapped else labelled
    hits = marks.withColumn("_hits", F.when(F.size("_titles") > 0, F.filter("_lines", starts)).otherwise(F.array().cast(marks.schema["_lines"].dataType)))

    def active(s: Column) -> Column:
        last_title = F.array_max(F.filter(c("_titles"), lambda t: t["g"] <= s["g"]))
        last_end = F.array_max(F.filter(c("_ends"), lambda e: e <= s["g"]))
        return F.when(last_title.isNotNull() & (last_end.isNull() | (last_end < last_title["g"])), last_title["page"])

    def excerpt(s: Column) -> Column:
        if not wrapped:
            own = F.size(X.amount_tokens(s["line"])) > 0
            follow = s["next"].isNotNull() & ~X.any_of(X.compact(F.coalesce(s["next"], F.lit(""))), others)
            return F.when(~own & follow, F.concat_ws("\n", s["line"], s["next"])).otherwise(s["line"])
        joins = [s["line"], F.concat_ws(" ", s["line"], s["next"]), F.concat_ws(" ", s["line"], s["next"], s["next2"])]
        ok = lambda t: has_label(F.regexp_replace(t, X.AMOUNT_TOKEN, "")) & (F.size(X.amount_tokens(t)) >= 2)
        return F.coalesce(*[F.when(ok(t), t) for t in joins])

    rows = F.transform(
        "_hits",
        lambda s: F.struct(
            s["page"].alias("page"),
            s["page_line"].alias("page_line"),
            (s["g"] + s["page"]).alias("text_line"),
            active(s).alias("unit_page"),
            excerpt(s).alias("excerpt"),
        ),
    )
    live = hits.withColumn("_rows", F.filter(rows, lambda r: r["unit_page"].isNotNull() & r["excerpt"].isNotNull()))
    sign = F.abs if absolute else (lambda x: x)

    def finish(r: Column) -> Column:
        tokens = X.amount_tokens(r["excerpt"] if wrapped else F.element_at(F.split(r["excerpt"], "\n"), -1))
        # Only the page whose title opened the section is searched for its unit.
        page = F.get(c("_pages"), r["unit_page"] - 1)
        both = F.struct(tokens.alias("t"), X.unit_context(page, c("currency"), c("market")).alias("u"))
        return let(both, lambda z: _valued(r, z["t"], z["u"]))

    def _valued(r: Column, t: Column, unit: Column) -> Column:
        return F.struct(
            r["page"],
            r["page_line"],
            r["text_line"],
            F.when(F.size(t) >= 2, sign(X.amount(F.element_at(t, -2))).cast("double") * unit["multiplier"]).alias("current_value"),
            F.when(F.size(t) >= 2, sign(X.amount(F.element_at(t, -1))).cast("double") * unit["multiplier"]).alias("comparative_value"),
            unit["currency"].alias("currency"),
            unit["status"].alias("unit_status"),
        )

    keep = [x for x in docs.columns if x != "text"]
    return live.select(*keep, F.transform("_rows", finish).alias("rows"))


def _shares_prefix(line: Column, labels: Sequence[str]) -> Column:
    """The line begins with the first six characters of a label."""
    heads = tuple(dict.fromkeys(x[:6] for x in labels))
    import re

    return line.rlike("^(?:" + "|".join(re.escape(h) for h in heads) + ")")


def unique_row(rows: DataFrame) -> DataFrame:
    """No row REVIEW, several CONFLICT, one row its values when amount, unit and currency are complete."""
    n = F.size("rows")
    r = F.get(c("rows"), F.lit(0))
    complete = (
        (n == 1)
        & r["current_value"].isNotNull()
        & r["comparative_value"].isNotNull()
        & r["currency"].isNotNull()
        & (r["unit_status"] == "VALID")
    )
    keep = [x for x in rows.columns if x != "rows"]
    return rows.select(
        *keep,
        n.alias("match_count"),
        F.when(n > 1, "CONFLICT").otherwise("REVIEW").alias("status"),
        F.when(complete, r["current_value"]).alias("current_value"),
        F.when(complete, r["comparative_value"]).alias("comparative_value"),
        F.when(complete, r["currency"]).alias("row_currency"),
    )


# Wording of amounts.  Groups: share basis, currency, number, unit, trailing currency.
BEFORE = r"(?<=(^.{0,11}|.{12}))"
_CASH = r"(?:现金|現金)?"
_WORD = r"(?:股息|股利|红利|紅利)"
PER_SHARE_PATTERNS = (
    r"每(\d+)股(?:普通股)?(?:派发|派發|派付|分配|派)?" + _CASH + _WORD + r"?(" + X.CURRENCY_TOKEN + r")?" + X.NUMBER_TOKEN + r"(" + X.MONEY_UNIT_TOKEN + r")()",
    r"每()股(?:普通股)?(" + X.CURRENCY_TOKEN + r")?" + X.NUMBER_TOKEN + r"(" + X.MONEY_UNIT_TOKEN + r")()",
    r"()(us\$|hk\$|s\$)" + X.NUMBER_TOKEN + r"()(?:per|/)(?:ordinary)?share()",
)
_TAIL = r"(" + X.CURRENCY_TOKEN + r")?" + X.NUMBER_TOKEN + r"(" + X.MONEY_UNIT_TOKEN + r")(" + X.CURRENCY_TOKEN + r")?"
TOTAL_PATTERNS = (
    r"()(?:拟|擬|建议|建議|已)?(?:派发|派發|派付|支付|分配|宣派)?(?:普通)?" + _CASH + _WORD
    + r"(?:总额|總額|合计|合計|合共|金额|金額|共|总计|總計)?(?:为|為|约为|約為)?" + _TAIL,
    r"()(?:总计|總計|合计|合計|合共)(?:普通)?" + _CASH + _WORD + r"(?:为|為)?" + _TAIL,
    r"()(?:现金|現金)分红金额(?:\([^)]*\)|（[^）]*）)?(" + X.CURRENCY_TOKEN + r")?" + X.NUMBER_TOKEN + r"(" + X.MONEY_UNIT_TOKEN + r")?(" + X.CURRENCY_TOKEN + r")?",
)


def dividend_evidence(docs: DataFrame) -> DataFrame:
    """Dividend amounts of a report with kind, lifecycle, year, currency and unit.

    ``docs``: doc_id, company_id, fiscal_year, market, sha256, text.
    """
    # a page without any of the terms has no line with them: most pages end here, before they are cut into lines
    squeezed_page = X.compact(c("page_text"))
    p = pages_of(docs).where(X.any_of(squeezed_page, X.DIVIDEND_TERMS) & X.any_of(squeezed_page, X.ACTION_TERMS))
    keep = [x for x in docs.columns if x not in ("text", "currency")]
    pairs = F.transform(
        "lines",
        lambda x, j: F.struct((j + 1).alias("page_line"), F.concat_ws("\n", x, F.get(c("lines"), j + 1)).alias("t")),
    )
    relevant = F.filter(pairs, lambda s: X.relevant_dividend_text(X.compact(s["t"])))
    lines = p.select(*keep, "page", "page_text", F.explode(relevant).alias("s")).select(
        *keep, "page", "page_text", c("s.page_line").alias("page_line"), X.compact(c("s.t")).alias("squeezed")
    )

    def matches(pattern: str, kind: str) -> Column:
        whole = F.regexp_extract_all(c("squeezed"), F.lit(pattern), 0)

        def parse(m: Column, before: Column) -> Column:
            g = lambda i: F.regexp_extract(m, pattern, i)
            return F.struct(
                m.alias("m"), before.alias("pre"), g(1).alias("basis"), g(2).alias("cur"), g(3).alias("num"),
                g(4).alias("unit"), g(5).alias("post"), F.lit(kind).alias("kind"),
            )

        if kind == "PER_SHARE":
            return F.transform(whole, lambda m: parse(m, F.lit("")))
        # The twelve characters before a total decide whether it is a per-share amount; they are
        # looked up only where a total was found.
        before = F.regexp_extract_all(c("squeezed"), F.lit(BEFORE + pattern), 1)
        return let(
            whole,
            lambda w: F.when(
                F.size(w) > 0,
                F.filter(
                    F.zip_with(w, before, lambda m, p: parse(m, p)), lambda z: ~F.concat(z["pre"], z["m"]).rlike(r"每股|每\d+股")
                ),
            ).otherwise(F.transform(w, lambda m: parse(m, F.lit("")))),
        )

    found = F.concat(*[matches(x, "PER_SHARE") for x in PER_SHARE_PATTERNS], *[matches(x, "TOTAL") for x in TOTAL_PATTERNS])
    m = lines.select(*keep, "page", "page_text", "page_line", "squeezed", F.explode(found).alias("z"))
    kind = c("z.kind")
    basis = F.when(kind == "PER_SHARE", F.coalesce(c("z.basis").try_cast("int"), F.lit(1)))
    raw_currency = F.coalesce(F.nullif(c("z.cur"), F.lit("")), F.nullif(c("z.post"), F.lit("")), F.lit(""))
    staged = m.select(
        *keep,
        "page",
        "page_line",
        kind.alias("amount_kind"),
        c("z.num").alias("raw_value"),
        F.regexp_replace("z.num", ",", "").try_cast("decimal(28,6)").alias("value"),
        basis.alias("share_basis"),
        X.money_currency(F.concat(raw_currency, c("z.unit")), c("z.unit"), c("market")).alias("currency"),
        X.money_unit(c("z.unit"), kind, basis).alias("unit"),
        X.dividend_kind(c("squeezed")).alias("dividend_kind"),
        X.dividend_component(c("squeezed"), kind).alias("component"),
        X.dividend_lifecycle(c("squeezed"), c("page_text")).alias("lifecycle_status"),
        X.associated_year(c("squeezed"), c("fiscal_year")).alias("_y"),
        evidence_id(c("sha256"), c("page"), c("page_line"), kind, X.dividend_kind(c("squeezed")), c("z.num"), raw_currency, c("z.unit")).alias("evidence_id"),
    )
    named = staged.select(
        *keep, "page", "page_line", "amount_kind", "raw_value", "value", "share_basis", "currency", "unit", "dividend_kind",
        "component", "lifecycle_status", c("_y.year").alias("associated_fiscal_year"), c("_y.basis").alias("year_basis"), "evidence_id",
    )
    # The same statement seen from two neighbouring lines counts once, at its first line.
    from cashlens.operators.scale import earliest_by

    identity = ["doc_id", "page", "amount_kind", "dividend_kind", "lifecycle_status", "raw_value", "currency", "unit", "component"]
    return earliest_by(named, identity, [c("page_line"), c("evidence_id")])


LIFECYCLE_GROUPS = {"PAID": "PAID_OR_APPROVED", "APPROVED": "PAID_OR_APPROVED", "DECLARED": "DECLARED", "PROPOSED": "PROPOSED"}
SLOT_KINDS = ("ORDINARY", "SPECIAL")
SLOT_GROUPS = ("PAID_OR_APPROVED", "DECLARED", "PROPOSED")
SLOT_AMOUNTS = ("TOTAL", "PER_SHARE")


def lifecycle_group(status: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in LIFECYCLE_GROUPS.items():
        out = out.when(status == k, v)
    return out


def resolve_slots(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Per slot: one value signature is a REVIEW candidate, several of one component a CONFLICT.

    Compared through min and max of the signature, so no list of candidates is built.
    """
    usable = evidence.withColumn("lifecycle_group", lifecycle_group(c("lifecycle_status"))).where(
        c("lifecycle_group").isNotNull()
        & c("dividend_kind").isin(*SLOT_KINDS)
        & (c("associated_fiscal_year") == c("fiscal_year"))
        & c("value").isNotNull()
        & c("currency").isNotNull()
        & c("unit").isNotNull()
    )
    sig = F.struct("value", "currency", "unit", F.coalesce("share_basis", F.lit(0)).alias("share_basis"))
    g = usable.groupBy(*keys, "dividend_kind", "lifecycle_group", "amount_kind").agg(
        F.count(F.lit(1)).alias("match_count"),
        F.min(sig).alias("_lo"),
        F.max(sig).alias("_hi"),
        F.min("component").alias("_c1"),
        F.max("component").alias("_c2"),
    )
    single = c("_lo") == c("_hi")
    return g.select(
        *keys,
        "dividend_kind",
        "lifecycle_group",
        "amount_kind",
        "match_count",
        F.when(single | (c("_c1") != c("_c2")), "REVIEW").otherwise("CONFLICT").alias("slot_status"),
        F.when(single, c("_lo.value")).alias("value"),
        F.when(single, c("_lo.currency")).alias("currency"),
        F.when(single, c("_lo.unit")).alias("unit"),
    )


def slot_ledger(subjects: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """All twelve slots of each subject, MISSING where nothing was found."""
    slots = F.array(
        *[
            F.struct(F.lit(k).alias("dividend_kind"), F.lit(g).alias("lifecycle_group"), F.lit(a).alias("amount_kind"))
            for k in SLOT_KINDS
            for g in SLOT_GROUPS
            for a in SLOT_AMOUNTS
        ]
    )
    wanted = subjects.select(*keys).distinct().select(*keys, F.explode(slots).alias("s")).select(*keys, "s.*")
    j = wanted.join(resolved, [*keys, "dividend_kind", "lifecycle_group", "amount_kind"], "left")
    return j.withColumns(
        {"slot_status": F.coalesce("slot_status", F.lit("MISSING")), "match_count": F.coalesce("match_count", F.lit(0))}
    )


def share_total_rows(docs: DataFrame) -> DataFrame:
    """Opening and closing issued shares from the share-change table of a mainland report, inside the row."""
    keep = [x for x in docs.columns if x != "text"]

    def table_rows(page: Column) -> Column:
        squeezed = F.translate(F.regexp_replace(page, r"\s+", ""), "：", ":")
        inside = X.any_of(squeezed, X.SHARE_UNIT_TERMS)
        for term in X.SHARE_TABLE_TERMS:
            inside = inside & squeezed.contains(term)
        hits = F.filter(page_lines(page), lambda x: F.regexp_replace(x, r"\s+", "").rlike(X.SHARE_TOTAL_ROW))
        rows = F.transform(hits, lambda x: X.integral_share_tokens(F.trim(x)))
        return F.when(inside, rows).otherwise(F.array().cast("array<array<bigint>>"))

    pages = docs.withColumn("_pages", F.split("text", "\f")).drop("text")
    found = pages.withColumns(
        {
            "_rows": F.flatten(F.transform("_pages", table_rows)),
            "markers": F.array_sort(F.array_distinct(F.flatten(F.transform("_pages", X.split_markers)))),
        }
    )
    first = F.get(c("_rows"), F.lit(0))
    usable = (F.size("_rows") == 1) & (F.size(first) >= 2)
    return found.select(
        *keep,
        F.size("_rows").alias("row_count"),
        F.when(usable, F.get(first, F.lit(0))).alias("opening_issued_shares"),
        F.when(usable, F.element_at(first, -1)).alias("closing_issued_shares"),
        "markers",
        F.when(F.size("_rows") > 1, "CONFLICT").otherwise("REVIEW").alias("status"),
    )


LOOK_BACK = 45


def issued_lines(lines: Column, back: int = LOOK_BACK) -> Column:
    """Per line of a page: is the nearest issued / authorised heading of the last lines an issued one."""

    def mark(x: Column) -> Column:
        s = F.regexp_replace(x, r"\s+", "")
        return F.when(X.any_of(s, X.ISSUED_LABELS), F.lit(True)).when(X.any_of(s, X.AUTHORISED_LABELS), F.lit(False))

    marks = F.filter(
        F.transform(lines, lambda x, j: F.struct(j.alias("j"), mark(x).alias("issued"))), lambda m: m["issued"].isNotNull()
    )
    return let(
        F.struct(lines.alias("l"), marks.alias("m")),
        lambda z: F.transform(
            z["l"],
            lambda _, j: F.coalesce(
                F.array_max(F.filter(z["m"], lambda m: (m["j"] <= j) & (m["j"] > j - back)))["issued"], F.lit(False)
            ),
        ),
    )


def share_balance_rows(docs: DataFrame) -> DataFrame:
    """Opening, closing and cancelled shares of a Hong Kong share-capital note.

    ``docs``: doc_id, fiscal_year, text and keys.  Pages are picked and, of the lines under an issued heading, those with
    an opening, closing or cancellation term exploded on the map side; only those few lines are parsed and aggregated per
    document.  What several rules read is a column of its own select, so it is computed once per line.
    """
    keep = [x for x in docs.columns if x != "text"]
    squeezed = F.regexp_replace("page_text", r"\s+", "")
    heading = F.exists("lines", lambda x: x.rlike(r"^\s*\d+(?:\.\d+)?[.、]?\s*(?:發\s*行\s*)?股\s*本"))
    capital = X.any_of(squeezed, X.ISSUED_LABELS) & (heading | X.any_of(squeezed, X.CAPITAL_CHANGE_TERMS))
    pages = pages_of(docs, offsets=False).where(capital).select(
        *keep, "lines", X.share_multiplier(c("page_text")).alias("mult"), X.any_of(squeezed, X.CANCEL_PHRASES).alias("explicit")
    )
    issued = F.filter(
        F.transform(
            F.arrays_zip(c("lines").alias("x"), issued_lines(c("lines")).alias("on")),
            lambda z, j: F.struct(j.alias("j"), F.when(z["on"], X.compact(z["x"])).alias("flat_line")),
        ),
        lambda z: X.any_of(z["flat_line"], (*X.OPENING_TERMS, *X.CLOSING_TERMS, *X.CANCEL_LABELS)),
    )
    line_at = lambda j: F.get(c("lines"), j)
    told = F.transform(
        issued,
        lambda z: F.struct(
            line_at(z["j"]).alias("line"),
            z["flat_line"].alias("flat_line"),
            F.concat_ws(" ", F.trim(line_at(z["j"])), F.trim(line_at(z["j"] + 1))).alias("both"),
            F.concat_ws(" ", F.slice(c("lines"), F.greatest(z["j"] - 4, F.lit(1)), F.least(z["j"] + 1, F.lit(6)))).alias("before"),
        ),
    )
    hits = pages.select(*keep, "mult", "explicit", F.explode(told).alias("z")).select(*keep, "mult", "explicit", "z.*")
    flat = hits.withColumns({"flat": X.compact(c("both")), "starts": X.any_of(c("flat_line"), X.OPENING_TERMS)})
    year = c("fiscal_year").cast("string")
    digits = X.ascii_digits(c("flat"))
    read = flat.withColumns(
        {
            "mentioned": X.years_mentioned(c("both"), c("flat")),
            "december": F.contains(digits, F.concat(year, F.lit("年十2月3十1日"))) | F.contains(digits, F.concat(year, F.lit("年12月31日"))),
            "before": F.when(c("explicit") & X.any_of(c("flat_line"), X.CANCEL_LABELS), X.years_mentioned(c("before"))),
        }
    )
    unnamed = F.size("mentioned") == 0
    scoped = read.withColumns(
        {
            "in_scope": unnamed | F.array_contains("mentioned", year),
            "ends": (X.any_of(c("flat_line"), X.CLOSING_TERMS) & (unnamed | c("december"))) | (c("starts") & c("december") & c("flat").rlike("[至及]")),
            "cancels": c("before").isNotNull() & ((F.size("before") == 0) | F.array_contains("before", year)),
        }
    )
    undated = F.regexp_replace("both", X.DATE_PATTERN, " ")
    whole = lambda t: F.filter(F.transform(X.amount_tokens(t), X.amount), lambda v: v == F.floor(v))
    minimum = F.when(c("mult") > 1, 1_000).otherwise(100_000)
    sized = F.filter(
        whole(undated), lambda v: (v >= minimum) & (v != c("fiscal_year")) & (v != c("fiscal_year") - 1)
    )
    negative = F.filter(whole(c("line")), lambda v: v < 0)
    rows = scoped.select(
        *keep,
        F.when(c("in_scope") & (c("starts") | c("ends")), (F.get(sized, F.lit(0)) * c("mult")).cast("bigint")).alias("value"),
        "starts",
        "ends",
        F.when(c("in_scope") & c("cancels"), (-F.get(negative, F.lit(0)) * c("mult")).cast("bigint")).alias("cancelled"),
    )
    opening, closing = F.when(c("starts"), c("value")), F.when(c("ends"), c("value"))
    g = rows.groupBy(*keep).agg(
        F.count(opening).alias("opening_rows"),
        F.max(opening).alias("_o"),
        F.count(closing).alias("closing_rows"),
        F.max(closing).alias("_c"),
        F.count("cancelled").alias("cancel_rows"),
        F.max("cancelled").alias("_x"),
    )
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    j = join_null_safe(docs.select(*keep), g, keep, "left")
    return j.select(
        *keep,
        F.when(c("opening_rows") == 1, c("_o")).alias("opening_issued_shares"),
        F.when(c("closing_rows") == 1, c("_c")).alias("closing_issued_shares"),
        F.when((zero("opening_rows") > 1) | (zero("closing_rows") > 1), "CONFLICT").otherwise("REVIEW").alias("status"),
        F.when(c("cancel_rows") == 1, c("_x")).alias("cancelled_shares_candidate"),
        F.when(zero("cancel_rows") == 1, "VALID").when(zero("cancel_rows") > 1, "CONFLICT").otherwise("MISSING").alias("cancel_status"),
    )


def best_documents(docs: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Best document per company and fiscal year by a five-part score, newest years first.

    The best one comes from an aggregate, so a year with very many documents is not sorted.
    """
    title = F.regexp_replace("source_document", r"\s+", "")
    marker = r"(?:年|年度)?(?:年度报告|年度報告|年报|年報)(?:（?(?:修订|修訂|更正|重述|更新版)[^）)]*）?)?$"
    exact = F.regexp_like(title, F.concat(F.lit("(?i)^"), c("fiscal_year").cast("string"), F.lit(marker)))
    valid = docs.where((c("fiscal_year_end_date") <= as_of) & (c("publish_date") <= as_of))
    scored = valid.withColumns(
        {
            "_exact": F.when(exact, 2).otherwise(1),
            "_restated": c("source_document").rlike(X.RESTATEMENT_PATTERN).cast("int"),
            "_size": F.coalesce("source_size_hint_kb", F.lit(0)),
            "_id": F.coalesce(c("source_announcement_id").cast("string"), F.lit("")),
        }
    )
    order = [c("_exact"), c("_restated"), c("_size"), c("publish_date"), c("_id")]
    keys = ["company_id", "fiscal_year"]
    best = latest_by(scored, keys, order)
    n = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_count"))
    w = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))
    out = best.join(n, keys).withColumn("_k", F.row_number().over(w)).where(c("_k") <= limit)
    return out.withColumns(
        {
            "restatement_status": F.when(c("_restated") == 1, "RESTATED").otherwise("ORIGINAL"),
            "selection_status": F.lit("SELECTED_CURRENT"),
        }
    ).drop("_exact", "_restated", "_size", "_id", "_k")


def document_check_columns(docs: DataFrame, official_hosts: Sequence[str], minimum_pages: int = 50) -> DataFrame:
    """The named checks of an official report as boolean columns (see ``quality.document_checks``)."""
    url = c("source_url")
    return docs.withColumns(
        {
            "selected_current": c("selection_status") == "SELECTED_CURRENT",
            "manifest_data_verified": c("data_status") == "VERIFIED",
            "official_source_level": c("source_level").isin("OFFICIAL_DISCLOSURE_PLATFORM", "OFFICIAL_EXCHANGE"),
            "official_https_url": url.startswith("https://") & F.try_parse_url(url, F.lit("HOST")).isin(*official_hosts),
            "annual_report_title": c("source_document").rlike(X.ANNUAL_PATTERN),
            "not_correction_summary_or_circular": ~c("source_document").rlike(X.NON_FULL_TITLE_PATTERN),
            "full_report_page_count": c("actual_pages") >= minimum_pages,
            "manifest_page_count_exact": c("actual_pages") == c("declared_pages"),
            "manifest_file_size_exact": c("actual_size") == c("declared_size"),
            "manifest_sha256_exact": c("actual_sha256") == c("declared_sha256"),
            "issuer_identity": X.issuer_name_present(c("text"), c("company_name")) | X.ticker_present(c("text"), c("ticker")),
            "annual_report_marker": c("text").rlike(X.ANNUAL_PATTERN),
            "fiscal_year_marker": X.year_present(c("text"), c("fiscal_year")),
            "independent_auditor_report": c("text").rlike(X.AUDITOR_PATTERN),
            "consolidated_cashflow_statement": c("text").rlike(X.CASHFLOW_STATEMENT_PATTERN),
        }
    )


def listing_rows(pages: DataFrame) -> DataFrame:
    """Linked entries of a listing page: position, target and title, from the whole page."""
    item = F.lit(r'(?s)<li>\s*<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>\s*</li>')
    z = F.arrays_zip(F.regexp_extract_all("html", item, 1).alias("href"), F.regexp_extract_all("html", item, 2).alias("title"))
    return pages.select("page_id", "url", F.posexplode(z).alias("position", "z")).select(
        "page_id", "url", "position", c("z.href").alias("href"), X.clean(F.regexp_replace("z.title", "<[^>]+>", "")).alias("title")
    )


def announcement_rows(pages: DataFrame) -> DataFrame:
    """Table rows of an announcement page: release date, title, document link and id."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("position", "row"))
    link = F.nullif(F.regexp_extract("row", r'href="([^"]+\.pdf)"', 1), F.lit(""))
    label = X.clean(F.regexp_replace(F.regexp_extract("row", r'(?s)<a[^>]*>(.*?)</a>', 1), "<[^>]+>", ""))
    day = F.regexp_extract("row", r"(\d{2}/\d{2}/\d{4})", 1)
    return rows.where(link.isNotNull()).select(
        "page_id",
        "position",
        label.alias("title"),
        F.try_to_date(F.nullif(day, F.lit("")), "dd/MM/yyyy").alias("publish_date"),
        link.alias("url"),
        F.regexp_extract(link, r"([^/]+)\.pdf$", 1).alias("document_id"),
        X.fiscal_year(label).alias("fiscal_year"),
    )
