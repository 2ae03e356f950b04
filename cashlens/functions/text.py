"""Report text: normalisation, numbers, units, years, titles, dividend wording.

Everything is a Column expression over one row, so text never leaves the JVM and is never shuffled
for parsing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashlens.functions.numeric import WIDE, let, lit_null

# ---- Fixed values: word lists and patterns that decide what is read from a report. ----
NEWS_PATTERN = (
    r"(?i)分红|派息|股息|利润分配|回购|购回|注销|库存股|库藏股|年度报告|年报|中期报告|中报|"
    r"dividend|buyback|repurchase|share repurchase|annual report|interim report"
)
ANNUAL_PATTERN = r"(?i)年度报告|年度報告|年报|年報|annual\s+report"
EXCLUDED_TITLE_PATTERN = (
    r"(?i)摘要|英文版|英文版本|通知信函|发布通知|發佈通知|回条|回條|申请表格|變更申請|变更申请|補充公告|补充公告|"
    r"中期|半年度|季度|季报|季報|業績公告|业绩公告|環境|环境|ESG|社會責任|社会责任|通函|更正公告|更正說明|更正说明"
)
NON_FULL_TITLE_PATTERN = r"更正公告|更正通知|補充公告|补充公告|摘要|通函|中期|半年度|季度|季報|季报"
RESTATEMENT_PATTERN = r"(?i)修订|修訂|更正|重述|更新版"
AUDITOR_PATTERN = (
    r"(?i)审计报告|審計報告|独立审计师报告|獨立審計師報告|独立核数师报告|獨立核數師報告|"
    r"independent\s+auditor(?:'s|’s|s’)?\s+report"
)
CASHFLOW_STATEMENT_PATTERN = (
    r"(?i)合并现金流量表|合併現金流量表|综合现金流量表|綜合現金流量表|"
    r"consolidated\s+(?:statement\s+of\s+cash\s+flows|cash\s+flow\s+statement)"
)
CJK_DIGITS = "〇零○Ｏ一二三四五六七八九"
CJK_DIGITS_ASCII = "0000123456789"
STATEMENT_TITLES = ("合并现金流量表", "合併現金流量表", "综合现金流量表", "綜合現金流量表")
TITLE_EXCLUSIONS = ("附注", "附註", "补充资料", "補充資料", "主要项目", "主要項目")
STATEMENT_ENDS = (
    "所有者权益变动表", "所有者權益變動表", "股东权益变动表", "股東權益變動表", "權益變動表", "权益变动表",
)
CFO_LABELS = (
    "经营活动产生的现金流量净额", "经营活动现金流量净额", "经营活动产生现金流量净额", "經營活動產生的現金流量淨額",
    "經營活動產生之現金流量淨額", "經營活動現金流量淨額", "經營活動所得之現金淨額", "經營活動所得現金淨額",
    "經營活動之現金流入淨額", "經營活動產生之現金淨額", "netcashfromoperatingactivities",
    "netcashgeneratedfromoperatingactivities", "netcashprovidedbyoperatingactivities",
    "netcashinflowfromoperatingactivities",
)
CAPEX_LABELS = ("购建固定资产、无形资产和其他长期资产支付的现金", "購建固定資產、無形資產和其他長期資產支付的現金")
FIXED_ASSET_LABELS = (
    "购买物业、厂房及设备", "購買物業、廠房及設備", "购买物业、厂房及机器设备", "購買物業、廠房及機器設備",
    "购置物业、厂房及设备", "購置物業、廠房及設備", "购入物业、厂房及设备", "購入物業、廠房及設備",
    "购入物业、机器及设备", "購入物業、機器及設備", "添置物业、厂房及设备", "添置物業、廠房及設備",
    "购买固定资产", "購買固定資產", "购入固定资产", "購入固定資產", "添置固定资产", "添置固定資產",
    "purchaseofproperty,plantandequipment", "purchasesofproperty,plantandequipment",
    "purchaseofproperty,plantandmachinery", "paymentforpurchaseofproperty,plantandequipment",
    "paymentsforpurchaseofproperty,plantandequipment",
)
INTANGIBLE_LABELS = (
    "购买无形资产", "購買無形資產", "购入无形资产", "購入無形資產", "购置无形资产", "購置無形資產",
    "添置无形资产", "添置無形資產", "工程开发成本之资本化开支", "工程開發成本之資本化開支", "资本化开发支出",
    "資本化開發支出", "purchaseofintangibleassets", "purchasesofintangibleassets",
    "paymentforpurchaseofintangibleassets", "paymentsforpurchaseofintangibleassets",
    "capitaliseddevelopmentcosts", "capitalizeddevelopmentcosts",
)
# pattern, currency, multiplier
PAGE_UNITS = (
    (r"人民币百万元|人民幣百萬元|(?i:RMB\s*(?:million|mn)\b)", "CNY", 1_000_000),
    (r"人民币万元|人民幣萬元", "CNY", 10_000),
    (r"人民币千元|人民幣千元|(?i:RMB\s*(?:['’]?000|thousand)\b)", "CNY", 1_000),
    (r"人民币元|人民幣元", "CNY", 1),
    (r"港(?:币|幣)百万元|港元百萬元|(?i:HK\$\s*(?:million|mn)\b)", "HKD", 1_000_000),
    (r"港(?:币|幣)万元|港元萬元", "HKD", 10_000),
    (r"千港元|港(?:币|幣)千元|(?i:HK\$\s*(?:['’]?000|thousand)\b)", "HKD", 1_000),
    (r"美元百万元|美元百萬元|(?i:US\$\s*(?:million|mn)\b|USD\s*(?:million|mn)\b)", "USD", 1_000_000),
    (r"美元万元|美元萬元", "USD", 10_000),
    (r"千美元|美元千元|(?i:US\$\s*(?:['’]?000|thousand)\b|USD\s*(?:['’]?000|thousand)\b)", "USD", 1_000),
)
PAGE_GENERIC_UNITS = (
    (r"单位\s*[:：]\s*百万元|單位\s*[:：]\s*百萬元", 1_000_000),
    (r"单位\s*[:：]\s*亿元|單位\s*[:：]\s*億元", 100_000_000),
    (r"单位\s*[:：]\s*万元|單位\s*[:：]\s*萬元", 10_000),
    (r"单位\s*[:：]\s*千元|單位\s*[:：]\s*千元", 1_000),
    (r"单位\s*[:：]\s*元|單位\s*[:：]\s*元", 1),
)
AMOUNT_TOKEN = r"(?=[-−\d\(（])(?<![\d.])(?:[-−]?\d[\d,]*(?:\.\d+)?|[\(（]\s*\d[\d,]*(?:\.\d+)?\s*[\)）])(?![\d.])"
DIVIDEND_TERMS = ("股息", "股利", "红利", "紅利", "现金分红", "現金分紅", "dividend")
SPECIAL_TERMS = ("特别股息", "特別股息", "特殊股息", "specialdividend")
SOFT_EXCLUSIONS = (
    "股息收益率", "预期股息", "預期股息", "股息等值", "应付股息", "應付股息", "预扣税", "預扣稅",
    "非控股权益", "非控股權益", "来自权益法", "來自權益法",
)
HARD_EXCLUSIONS = (
    "换股价", "換股價", "转股价", "轉股價", "每股盈利", "每股收益", "每股资产", "每股資產", "股息率",
)
SOFT_OVERRIDES = ("派发", "派發", "派付", "支付", "宣派", "普通股息")
ACTION_TERMS = (
    "派发", "派發", "派付", "支付", "宣派", "批准", "通过", "通過", "建议", "建議", "拟", "擬", "利润分配",
    "利潤分配", "现金分红金额", "現金分紅金額", "普通股息", "中期股息", "末期股息", "特别股息", "特別股息",
    "paid", "declared", "approved", "proposed", "recommended",
)
PAID_TERMS = ("已派付", "已支付", "已派发", "已派發", "派发完毕", "派發完畢", "paid")
APPROVED_TERMS = ("股东大会审议通过", "股東大會審議通過", "获批准", "獲批准", "approved")
PROPOSED_TERMS = ("拟派", "擬派", "建议", "建議", "proposed", "recommended")
DECLARED_TERMS = ("宣派", "宣佈", "宣布", "declared")
DECLARED_AND_PAID_TERMS = ("已宣派及派付", "已宣派和派付", "declaredandpaid")
REPORT_YEAR_TERMS = ("本报告期", "本報告期", "本年度", "本财政年度", "本財政年度")
PROPOSAL_PAGE_TERMS = ("本报告期利润分配预案", "本報告期利潤分配預案")
MEETING = r"(?:股东大会|股東大會)"
PASSED = r"(?:审议通过|審議通過|审议批准|審議批准|批准)"
PENDING_PATTERN = (
    r"(?:尚需|尚须|尚須|尚待|拟提交|擬提交|将提交|將提交|拟提请|擬提請|将提请|將提請|需|须|須|待)[^。；;]{0,100}"
    + MEETING + r"[^。；;]{0,60}" + PASSED
)
AFTER_APPROVAL_PATTERN = (
    r"(?:预案|預案)[^。；;]{0,120}(?:经|經)[^。；;]{0,60}" + MEETING + r"[^。；;]{0,40}" + PASSED + r"(?:后|後)(?:实施|實施|生效)"
)
EFFECTIVE_DATE_PATTERN = (
    r"自[^。；;]{0,80}" + MEETING + r"[^。；;]{0,50}" + PASSED
    + r"[^。；;]{0,40}(?:利润分配方案预案|利潤分配方案預案|之日|之日起|當日|当日)"
)
PAST_APPROVAL_PATTERN = r"20\d{2}年\d{1,2}月\d{1,2}日(?:经|經)[^。；;]{0,40}" + MEETING + r"[^。；;]{0,30}" + PASSED
CURRENCY_TOKEN = (
    r"(?:人民币|人民幣|港币|港幣|港元|美元|美金|新加坡元|新加坡幣|欧元|歐元|英镑|英鎊|日元|日圓|rmb|cny|hkd|usd|"
    r"hk\$|us\$|s\$|\$)"
)
MONEY_UNIT_TOKEN = (
    r"(?:亿元|億元|百万元|百萬元|百万|百萬|万元|萬元|港元|人民币元|人民幣元|美元|新加坡元|欧元|歐元|英镑|英鎊|"
    r"日元|日圓|元|分|仙|美分)"
)
NUMBER_TOKEN = r"(\d[\d,]*(?:\.\d+)?)"
# currency code -> tokens, in the order they are tried
CURRENCIES = (
    ("CNY", ("人民币", "人民幣", "rmb", "cny")),
    ("HKD", ("港币", "港幣", "港元", "hkd", "hk$")),
    ("USD", ("美元", "美金", "usd", "us$")),
    ("SGD", ("新加坡元", "新加坡幣", "s$")),
    ("EUR", ("欧元", "歐元")),
    ("GBP", ("英镑", "英鎊")),
    ("JPY", ("日元", "日圓")),
)
SPLIT_ACTION = r"(?:实施|完成|进行|发生|本次|报告期内)"
SPLIT_PATTERNS = (
    ("STOCK_SPLIT", SPLIT_ACTION + r".{0,30}(?:拆股|股份拆细|股份拆分|股票拆细|股票拆分)"),
    ("REVERSE_SPLIT", SPLIT_ACTION + r".{0,30}(?:并股(?!东)|缩股|股份合并|股票合并)"),
)
SHARE_TOTAL_ROW = r"^(?:[一-鿿]*[、.．]?\s*)?股份总数"
SHARE_TABLE_TERMS = ("股份变动情况", "本次变动前", "本次变动后")
SHARE_UNIT_TERMS = ("单位:股", "单位为股")
ISSUED_LABELS = ("已發行及繳足", "已发行及缴足")
AUTHORISED_LABELS = ("法定股本", "法定：", "法定:")
CAPITAL_CHANGE_TERMS = ("本公司已發行股本變動如下", "本公司已发行股本变动如下")
OPENING_TERMS = ("於年初", "于年初", "一月一日", "1月1日")
CLOSING_TERMS = ("於年末", "于年末", "於結算日", "于结算日", "十二月三十一日", "12月31日")
CANCEL_LABELS = (
    "回購股份", "回购股份", "購回和註銷股份", "购回和注销股份", "購回及註銷股份", "回購及註銷股份", "股份回購及註銷",
)
CANCEL_PHRASES = ("回購及註銷", "回购及注销", "購回和註銷", "购回和注销", "購回及註銷")
DATE_PATTERN = r"(?i)20\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日|\d{1,2}\s+(?:January|December)\s+20\d{2}"
NAME_SUFFIXES = ("股份有限公司", "控股有限公司", "有限公司", "股份", "控股", "集团")
CODE_LABEL = r"(?:公司代码|股票代码|证券代码|股份代号|股份代號|股份编号|股份編號|stock\s*codes?)"
# ---- End of fixed values. ----


def compact(c: Column) -> Column:
    """Whitespace removed, full-width punctuation folded, lower case."""
    squeezed = F.regexp_replace(c, r"\s+", "")
    return F.lower(F.translate(squeezed, "：，（）", ":,()"))


def clean(c: Column) -> Column:
    """Runs of whitespace to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def fold_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]", "")


def guarded(alternatives: str, first: str) -> str:
    """Pattern with a cheap first-character test in front, so most positions fail at once."""
    return f"(?=[{first}])(?:{alternatives})"


def any_of(c: Column, terms: Sequence[str]) -> Column:
    """True when one of the fixed terms occurs (one compiled pattern, one pass)."""
    import re

    quoted = "|".join(re.escape(t).replace("\\-", "-") for t in terms)
    first = "".join(dict.fromkeys(re.escape(t[0]) for t in terms))
    return c.rlike(guarded(quoted, first))


def amount(token: Column) -> Column:
    """Decimal of a number token: separators dropped, brackets or a minus sign make it negative."""
    plain = F.translate(F.trim(token), "−（）,", "-()")  # a character without a counterpart is dropped
    bracketed = plain.startswith("(") & plain.endswith(")")
    digits = F.translate(plain, "() ", "").try_cast(WIDE)
    return F.when(bracketed, -digits).otherwise(digits)


def amount_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(AMOUNT_TOKEN), 0)


def integral_share_tokens(line: Column) -> Column:
    """Positive whole share counts of a table row; percentages and fractions are left out.

    With three or more cells a value of 100 is the percentage column.
    """
    raw = F.regexp_extract_all(line, F.lit(r"(?<![\d.−-])(\d[\d,]*(?:\.0+)?)(?!\s*[%％]|[\d.,])"), 1)
    values = F.filter(
        F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(t, ",", ""), r"\.0+$", "").try_cast("bigint")),
        lambda v: v > 0,
    )
    return let(values, lambda v: F.when(F.size(v) >= 3, F.filter(v, lambda x: x != 100)).otherwise(v))


def _all_at(alternatives: str, first: str) -> str:
    """Captures an alternative at every position where one starts, overlaps included."""
    return f"(?=[{first}])(?=({alternatives}))"


def _explicit_unit(word: Column) -> Column:
    out = F.when(F.lit(False), F.struct(F.lit("").alias("currency"), F.lit(0.0).alias("multiplier")))
    for p, cur, mul in PAGE_UNITS:
        out = out.when(word.rlike("^(?:" + p + ")"), F.struct(F.lit(cur).alias("currency"), F.lit(float(mul)).alias("multiplier")))
    return out


def _generic_unit(word: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for p, mul in PAGE_GENERIC_UNITS:
        out = out.when(word.rlike("^(?:" + p + ")"), F.lit(float(mul)))
    return out


def unit_context(page: Column, currency: Column, market: Column) -> Column:
    """Struct(currency, multiplier, status) of a page: one explicit unit, several (CONFLICT), or none.

    One pass collects the unit words of the page (a look-ahead, so overlapping words all count); only
    those short words are then classified.
    """
    hits = let(
        F.array_distinct(F.regexp_extract_all(page, F.lit(_all_at("|".join(p for p, _, _ in PAGE_UNITS), "人港千美RrHhUu")), 1)),
        lambda words: F.array_distinct(F.array_compact(F.transform(words, _explicit_unit))),
    )
    generic = let(
        F.array_distinct(F.regexp_extract_all(page, F.lit(_all_at("|".join(p for p, _ in PAGE_GENERIC_UNITS), "单單")), 1)),
        lambda words: F.array_distinct(F.array_compact(F.transform(words, _generic_unit))),
    )

    def pack(cur: Column, mul: Column, status: str) -> Column:
        return F.struct(cur.alias("currency"), mul.alias("multiplier"), F.lit(status).alias("status"))

    nothing = (F.lit(None).cast("string"), lit_null())
    home = F.coalesce((market == "CN") & (currency == "CNY"), F.lit(False))
    return let(
        F.struct(hits.alias("h"), generic.alias("g")),
        lambda s: F.when(F.size(s["h"]) == 1, pack(s["h"][0]["currency"], s["h"][0]["multiplier"], "VALID"))
        .when(F.size(s["h"]) > 1, pack(*nothing, "CONFLICT"))
        .when((F.size(s["g"]) == 1) & home, pack(F.lit("CNY"), F.get(s["g"], F.lit(0)), "VALID"))
        .otherwise(pack(*nothing, "REVIEW")),
    )


def share_multiplier(page: Column) -> Column:
    """1,000,000, 1,000 or 1 from the unit words near the share-count heading."""
    near = r"(?s)(?:股份數目|股份数量|股份數量).{0,200}?"
    return (
        F.when(page.rlike(near + r"(?:百萬股|百万股)"), F.lit(1_000_000))
        .when(page.rlike(near + r"(?:千股|(?<![一-鿿])千(?![一-鿿]))"), F.lit(1_000))
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def ascii_digits(c: Column) -> Column:
    return F.translate(c, CJK_DIGITS, CJK_DIGITS_ASCII)


def years_mentioned(c: Column, flat: Column | None = None) -> Column:
    """Distinct years of this century in a text, in digits or CJK numerals; ``flat``: the text made compact, if there is one."""
    plain = F.regexp_extract_all(c, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), 1)
    cjk = F.transform(F.regexp_extract_all(compact(c) if flat is None else flat, F.lit("([二〇零一三四五六七八九]{4})"), 1), ascii_digits)
    return F.array_distinct(F.concat(plain, F.filter(cjk, lambda y: y.startswith("20"))))


def fiscal_year(title: Column) -> Column:
    """Fiscal year of a report title: range, year before or after the marker, CJK digits, English, bare year."""

    def found(c: Column, pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))

    marker = r"(?:年度报告|年度報告|年报|年報)"

    def span(start: Column, end_text: Column) -> Column:
        end = F.when(F.length(end_text) == 4, end_text.cast("int")).otherwise(
            F.floor(start / 100).cast("int") * 100 + end_text.cast("int")
        )
        return let(
            F.struct(start.alias("a"), end.alias("b")),
            lambda s: let(
                F.when(s["b"] < s["a"], s["b"] + 100).otherwise(s["b"]), lambda y: F.when(y.between(2000, 2100), y)
            ),
        )

    def parse(t: Column) -> Column:
        ranged = r"(?<!\d)(20\d{2})\s*[/／-]\s*(\d{2,4})"
        return F.when(
            t.rlike(ranged), span(F.regexp_extract(t, ranged, 1).cast("int"), F.regexp_extract(t, ranged, 2))
        ).otherwise(
            F.coalesce(
                found(t, r"(?i)(?<!\d)(20\d{2})(?!\d)\s*年?\s*(?:度\s*)?" + marker).cast("int"),
                found(t, r"(?i)" + marker + r"\s*(20\d{2})(?!\d)").cast("int"),
                ascii_digits(found(t, r"(?i)([〇零○Ｏ一二三四五六七八九]{4})\s*年?\s*(?:度\s*)?" + marker)).cast("int"),
                found(t, r"(?i)annual\s+report\D{0,12}(20\d{2})").cast("int"),
                found(t, r"(?i)(20\d{2})\D{0,12}annual\s+report").cast("int"),
                found(t, r"^(20\d{2})$").cast("int"),
            )
        )

    return let(clean(title), parse)


def date_from_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(20\d{2}-\d{2}-\d{2})/", 1), F.lit(""))


def is_full_report_title(title: Column) -> Column:
    return title.rlike(ANNUAL_PATTERN) & ~title.rlike(EXCLUDED_TITLE_PATTERN)


def title_anomalies(title: Column, pages: Column, minimum: int = 50) -> Column:
    return F.array_compact(
        F.array(
            F.when(~title.rlike(ANNUAL_PATTERN), F.lit("TITLE_IS_NOT_ANNUAL_REPORT")),
            F.when(title.rlike(NON_FULL_TITLE_PATTERN), F.lit("TITLE_IS_CORRECTION_SUMMARY_OR_CIRCULAR")),
            F.when(F.coalesce(pages, F.lit(0)) < minimum, F.lit("DOCUMENT_TOO_SHORT_FOR_FULL_ANNUAL_REPORT")),
        )
    )


def relevant_dividend_text(squeezed: Column) -> Column:
    """Required terms, hard exclusions, and soft exclusions that an action term overrides."""
    soft = any_of(squeezed, SOFT_EXCLUSIONS) & ~any_of(squeezed, SOFT_OVERRIDES)
    return any_of(squeezed, DIVIDEND_TERMS) & ~any_of(squeezed, HARD_EXCLUSIONS) & ~soft & any_of(squeezed, ACTION_TERMS)


def dividend_kind(squeezed: Column) -> Column:
    special = any_of(squeezed, SPECIAL_TERMS)
    return F.when(special & squeezed.contains("普通股息"), "AMBIGUOUS").when(special, "SPECIAL").otherwise("ORDINARY")


def dividend_component(squeezed: Column, amount_kind: Column) -> Column:
    return (
        F.when(any_of(squeezed, SPECIAL_TERMS), "SPECIAL")
        .when(squeezed.rlike("中期|interim"), "INTERIM")
        .when(squeezed.rlike("末期|finaldividend"), "FINAL")
        .when((amount_kind == "TOTAL") & squeezed.rlike("合计|合計|合共|总计|總計|总额|總額"), "ANNUAL_TOTAL")
        .when(squeezed.rlike("季度|quarter"), "QUARTERLY")
        .otherwise("UNSPECIFIED")
    )


def dividend_lifecycle(squeezed: Column, page: Column) -> Column:
    """PAID, APPROVED, PROPOSED, DECLARED, AMBIGUOUS or UNKNOWN.

    An approval that is still a condition counts as a proposal.
    """
    pending = (
        squeezed.rlike(PENDING_PATTERN)
        | squeezed.rlike(EFFECTIVE_DATE_PATTERN)
        | (squeezed.rlike(AFTER_APPROVAL_PATTERN) & ~squeezed.rlike(PAST_APPROVAL_PATTERN))
    )
    marks = F.struct(
        any_of(squeezed, PAID_TERMS).alias("paid"),
        any_of(squeezed, APPROVED_TERMS).alias("approved"),
        any_of(squeezed, DECLARED_TERMS).alias("declared"),
        any_of(squeezed, PROPOSED_TERMS).alias("worded"),
        pending.alias("pending"),
    )

    def ladder(m: Column) -> Column:
        proposed = m["worded"] | m["pending"]
        several = m["approved"].cast("int") + proposed.cast("int") + m["declared"].cast("int") > 1
        return (
            F.when(m["paid"] & m["declared"] & ~any_of(squeezed, DECLARED_AND_PAID_TERMS), "AMBIGUOUS")
            .when(m["paid"], "PAID")
            .when(m["pending"], "PROPOSED")
            .when(m["approved"] & ~proposed, "APPROVED")
            .when(proposed & ~m["approved"], "PROPOSED")
            .when(m["declared"] & ~proposed, "DECLARED")
            .when(several, "AMBIGUOUS")
            .when(any_of(compact(page), PROPOSAL_PAGE_TERMS), "PROPOSED")
            .otherwise("UNKNOWN")
        )

    return let(marks, ladder)


def associated_year(squeezed: Column, report_year: Column) -> Column:
    """Struct(year, basis): one explicit year outside brackets, several (ambiguous), or the report's own."""
    primary = F.element_at(F.split(squeezed, r"[（(]", 2), 1)
    arabic = F.regexp_extract_all(primary, F.lit(r"(?<!\d)(20\d{2})"), 1)
    cjk = F.transform(F.regexp_extract_all(primary, F.lit(r"([〇零一二三四五六七八九]{4})年"), 1), ascii_digits)
    years = F.array_distinct(F.concat(arabic, cjk))
    own = any_of(squeezed, REPORT_YEAR_TERMS)

    def pack(y: Column, b: str) -> Column:
        return F.struct(y.cast("int").alias("year"), F.lit(b).alias("basis"))

    return let(
        years,
        lambda y: F.when(F.size(y) == 1, pack(F.get(y, F.lit(0)), "EXPLICIT"))
        .when(F.size(y) > 1, pack(F.lit(None), "AMBIGUOUS_MULTIPLE_YEARS"))
        .when(own, pack(report_year, "REPORT_CONTEXT"))
        .otherwise(pack(F.lit(None), "MISSING")),
    )


def money_currency(joined: Column, unit: Column, market: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, tokens in CURRENCIES:
        out = out.when(any_of(joined, tokens), code)
    return out.when(joined.contains("$"), F.lit(None)).when(unit.isin("元", "分") & (market == "CN"), "CNY")


def money_unit(unit: Column, amount_kind: Column, basis: Column) -> Column:
    share = F.concat(F.lit("_per_"), F.coalesce(basis, F.lit(1)).cast("string"), F.lit("_shares"))
    known = F.length(F.coalesce(unit, F.lit(""))) > 0
    return (
        F.when(~known, F.lit(None))
        .when((amount_kind == "PER_SHARE") & unit.isin("分", "仙", "美分"), F.concat(unit, share))
        .when(amount_kind == "PER_SHARE", F.concat(F.lit("currency"), share))
        .when(unit.isin("亿元", "億元"), "hundred_million_currency")
        .when(unit.isin("百万元", "百萬元", "百万", "百萬"), "million_currency")
        .when(unit.isin("万元", "萬元"), "ten_thousand_currency")
        .otherwise("currency")
    )


def split_markers(page: Column) -> Column:
    """Split or consolidation codes found on the lines of a share-change page."""
    relevant = F.regexp_replace(page, r"\s+", "").rlike("股份变动情况|股本变动情况")
    found = F.array_compact(F.array(*[F.when(page.rlike(p), F.lit(code)) for code, p in SPLIT_PATTERNS]))
    return F.when(relevant, found).otherwise(F.array().cast("array<string>"))


def issuer_name_present(text: Column, name: Column) -> Column:
    """The folded name, or the name without a company-form suffix, occurs in the folded text."""
    folded = fold_name(name)
    alternatives = [folded]
    for suffix in NAME_SUFFIXES:
        cut = F.when(
            folded.endswith(suffix) & (F.length(folded) > len(suffix) + 1),
            F.substring(folded, F.lit(1), F.length(folded) - len(suffix)),
        )
        alternatives.append(cut)
    where = fold_name(text)
    return F.exists(
        F.array_compact(F.array(*alternatives)), lambda a: (F.length(a) >= 3) & F.contains(where, a)
    )


def ticker_present(text: Column, ticker: Column) -> Column:
    """A labelled listing code with the ticker's number near it."""
    number = F.regexp_replace(ticker, "^0+", "")
    pattern = F.concat(F.lit("(?i)" + CODE_LABEL + r"[^\n]{0,100}?0*"), number, F.lit(r"(?!\d)"))
    return F.regexp_like(text, pattern)


def year_tokens(year: Column) -> Column:
    """The year in digits and in CJK numerals."""
    return F.array(year.cast("string"), F.translate(year.cast("string"), "0123456789", "零一二三四五六七八九"))


def year_present(text: Column, year: Column) -> Column:
    return F.exists(year_tokens(year), lambda t: F.contains(text, t))


def display_market_value(value: Column, currency: Column) -> Column:
    """Market value in hundred millions with the currency's unit word."""
    unit = (
        F.when(currency == "CNY", "亿元")
        .when(currency == "HKD", "亿港元")
        .when(currency == "USD", "亿美元")
        .otherwise(F.trim(F.concat(F.lit("亿 "), F.coalesce(currency, F.lit("")))))
    )
    return F.coalesce(F.concat_ws(" ", F.format_number(value / 100_000_000, 2), F.when(value.isNotNull(), unit)), F.lit("—"))
