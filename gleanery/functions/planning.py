"""Queries made from questions, options and field packs; small inferences from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

# ---- fixed values -----------------------------------------------------------
SECTION_KEYWORDS = {
    "cover": ["封面", "首页", "发行人", "发行金额", "信用评级"],
    "statement": ["声明", "发行人承诺", "信息披露义务"],
    "important_notice": ["重大事项提示", "重大事项", "重要提示"],
    "issuance_overview": ["发行概况", "发行条款", "本期债券主要条款", "发行要素"],
    "definition": ["释义", "定义"],
    "risk_factors": ["风险因素", "风险提示"],
    "fund_usage": ["募集资金用途", "募集资金运用"],
    "issuer_info": ["发行人基本情况", "发行人概况", "公司概况"],
    "credit_info": ["资信状况", "信用情况", "信用评级"],
    "financial_info": ["财务会计信息", "财务数据", "主要财务指标", "财务报表"],
    "investor_protection": ["投资者保护", "债券持有人权利", "持有人会议"],
    "disclosure_arrangement": ["信息披露安排", "信息披露事务"],
    "trustee": ["受托管理人", "债券受托管理人"],
    "institutions": ["发行有关机构", "相关证券服务机构", "中介机构"],
    "transaction_overview": ["本次交易概况", "交易方案", "交易结构"],
    "listed_company_info": ["上市公司基本情况", "上市公司概况"],
    "counterparty_info": ["交易对方基本情况", "交易对方"],
    "target_info": ["交易标的", "标的公司", "标的资产"],
    "share_issuance": ["发行股份情况", "股份发行"],
    "management_discussion": ["管理层讨论与分析", "经营情况讨论"],
}
FIELD_QUERIES = {
    "issuer": "发行人 发行主体 公司名称",
    "current_issue_amount_max": "本期债券发行金额 发行规模 不超过",
    "registered_amount_max": "注册金额 注册额度 不超过",
    "total_issue_amount": "本次发行总额 发行总额",
    "subject_rating": "主体信用评级 主体评级 信用评级结果",
    "bond_rating": "债项信用评级 债项评级",
    "trustee": "受托管理人 债券受托管理人",
    "lead_underwriter": "牵头主承销商 主承销商",
    "bookrunner": "簿记管理人",
    "disclosure_commitment": "发行人承诺 及时 公平 信息披露义务",
    "investor_protection": "投资者保护 债券持有人权利 持有人会议",
    "put_option": "回售 回售条款 回售选择权 有条件回售 附加回售",
    "redemption": "赎回 赎回条款 有条件赎回 到期赎回",
    "asset_liability_ratio": "资产负债率 合并口径 母公司口径",
    "net_profit": "净利润 归属于母公司 年均可分配利润",
    "conversion_price": "转股价格 初始转股价 转股价格向下修正",
    "conversion_period": "转股期限 转股起始日",
    "conditional_redemption": "有条件赎回 赎回条款",
    "conditional_put": "有条件回售 回售条款",
    "transaction_structure": "发行股份购买资产 募集配套资金 交易结构 交易方案",
    "target_company": "标的公司 标的资产 交易标的",
    "transaction_counterparty": "交易对方 交易对手方",
    "default_clause": "违约 违约事件 违约情形",
    "penalty_interest": "违约利息 罚息 赔偿 补偿 惩罚系数",
    "stock_code": "股票代码 证券代码",
    "stock_name": "股票简称 证券简称",
    "issuance_date": "发行日期 发行公告日",
    "maturity_date": "兑付日 到期日 偿还日",
}
DEFAULT_FIELD_QUERY = "发行人 发行金额 信用评级"
#: (words in the question, keywords, fields, sections) of packs made without a plan.
FALLBACK_RULES = (
    (["发行人", "发行主体", "公司名称"], ["发行人", "发行主体"], ["issuer"], []),
    (["发行金额", "发行规模", "不超过"], ["发行金额", "发行规模", "本期债券", "不超过"], ["current_issue_amount_max"], []),
    (["注册金额", "注册额度"], ["注册金额", "注册额度"], ["registered_amount_max"], []),
    (["主体评级", "主体信用评级", "信用评级"], ["主体信用评级", "主体评级", "信用评级结果"], ["subject_rating"], []),
    (["债项评级", "债项信用评级"], ["债项评级", "债项信用评级"], ["bond_rating"], []),
    (["受托管理人", "债券受托管理人"], ["受托管理人", "债券受托管理人"], ["trustee"], []),
    (["回售", "赎回", "投资者保护", "持有人权利"], ["回售", "赎回", "投资者保护", "债券持有人权利"], ["put_option", "redemption", "investor_protection"], ["investor_protection", "issuance_overview"]),
    (["资产负债率", "净利润", "财务"], ["资产负债率", "净利润", "财务指标"], ["asset_liability_ratio", "net_profit"], ["financial_info", "important_notice"]),
    (["转股", "可转换", "可转债"], ["转股价格", "转股期限", "可转换公司债券"], ["conversion_price", "conversion_period"], ["issuance_overview"]),
    (["发行股份", "重组", "标的", "交易对方"], ["发行股份购买资产", "重大资产重组", "标的公司", "交易对方"], ["transaction_structure", "target_company"], ["transaction_overview", "target_info"]),
    (["违约", "罚息", "赔偿", "补偿"], ["违约", "违约利息", "罚息", "赔偿", "补偿"], ["default_clause", "penalty_interest"], []),
    (["信息披露", "披露义务"], ["信息披露", "披露义务", "及时", "公平"], ["disclosure_commitment"], ["statement", "disclosure_arrangement"]),
    (["股票代码", "证券代码", "股票简称"], ["股票代码", "证券代码", "股票简称"], ["stock_code", "stock_name"], []),
)
FALLBACK_SECTIONS = ["cover", "issuance_overview", "important_notice"]
UNIT_PATTERNS = (r"单位[:：]\s*([^\n\s,，；;]{1,24})", r"金额单位[:：]\s*([^\n\s,，；;]{1,24})", r"除特别注明外[,，]?单位[:：]\s*([^\n\s,，；;]{1,24})")
UNITS = ["千元", "百万元", "万元", "亿元", "元", "港元", "美元", "%", "万平方米", "GWh"]
MULTI_ENTITY = ["两家公司", "两份文档", "两款产品", "三家公司", "三份文档", "三款产品", "四家公司", "四份文档", "四款产品", "多家公司", "多份文档", "多款产品", "各家公司", "各产品", "各份文档", "均", "全部", "所有", "都"]
LAST_ANSWER = tuple(p + r"\s*\*{0,2}([A-D](?:[、,，\s]*[A-D])*)\*{0,2}" for p in (r"最终答案[是为]?[：:]", r"准确选项[：:]", r"正确项应为[：:]", r"答案[是为]?[：:]"))
RULE_KEY = r"(免赔额|赔付比例|退保费用|现金价值|账户价值)[为是：:]?([^，。；;]{1,30})"
DEADLINE = r"([0-9]+\s*个?工作日|[0-9]+\s*日|[0-9]+\s*年)内?"
MODALS = ["应当", "不得", "可以"]
COMPANY = r"([一-龥]{2,}(?:集团|公司|银行|保险|证券|基金|时代|电器))"
# ---- end of fixed values ------------------------------------------------------


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>") if words else F.array().cast("array<string>")


def last_answer(text: Column) -> Column:
    """Letters of the last match of the first pattern that matches, each once and in order; else empty."""
    out = F.lit("")
    for p in reversed(LAST_ANSWER):
        got = F.regexp_extract_all(text, F.lit(p), F.lit(1))
        letters = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.element_at(got, -1), F.lit("[A-D]"), F.lit(0)))), "")
        out = F.when(F.size(got) > 0, letters).otherwise(out)
    return out


def question_type(question: Column) -> Column:
    """A kind of question from its words, where none is given."""
    has = lambda *words: T.contains_any(question, words)
    return (
        F.when(question.contains("以下") & has("正确", "错误"), "option_verification").when(has("哪", "属于"), "selection")
        .when(has("计算", "多少", "金额", "比例"), "calculation").when(has("比较", "对比", "区别"), "comparison").otherwise("factual")
    )


def first_company(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, COMPANY, 1), F.lit(""))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "20[12][0-9]", 0), F.lit("")).cast("bigint")


def diversified_query(company: Column, year: Column, metrics: Column, option: Column) -> Column:
    """Company, year and up to three metrics before the option's text."""
    return F.concat_ws(" ", company, year.cast("string"), F.slice(metrics, 1, 3), option)


def metric_query(company: Column, year: Column, metrics: Column) -> Column:
    """Company, year and up to three metrics; null with no metric or fewer than two parts."""
    parts = F.array_compact(F.concat(F.array(company, F.concat(year.cast("string"), F.lit("年"))), F.slice(metrics, 1, 3)))
    return F.when((F.size(metrics) > 0) & (F.size(parts) >= 2), F.array_join(parts, " "))


def question_keywords(question: Column) -> Column:
    """The last clause of over four characters, at most 30 of them, once common openings are gone."""
    q = F.regexp_replace(question, r"^假设[^，。]*[，。]", "")
    q = F.regexp_replace(q, r"以下哪[些个].*?[，。]?", "")
    q = F.trim(F.regexp_replace(q, r"[（(][^）)]*[）)]", ""))
    q = F.trim(F.regexp_replace(q, r"^则[^，。]*?(?=会|是|有|包含|属于|超过|低于|达到|退还|支付|分配)", ""))
    q = F.regexp_replace(q, r"^[则哪些个]*产品[会是]", "")
    clauses = F.filter(F.transform(F.split(q, "[，。？]"), lambda x: F.trim(x)), lambda c: F.length(c) > 4)
    return F.when(F.size(clauses) > 0, F.substring(F.element_at(clauses, -1), 1, 30)).otherwise(F.right(question, F.lit(30)))


def entity_queries(question: Column, option: Column, doc_scope: Column, words: list[str] = MULTI_ENTITY, most: int = 4) -> Column:
    """array<struct<entity, query>>: the option itself if the question is about several entities, each of at
    least two documents if the option is; else none."""
    kind = "array<struct<entity:string,query:string>>"
    one = F.array(F.struct(option.alias("entity"), F.concat(option, F.lit(" "), question_keywords(question)).alias("query")))
    each = F.transform(F.slice(doc_scope, 1, most), lambda d: F.struct(d.cast("string").alias("entity"), option.alias("query")))
    return F.when(T.contains_any(question, words), one.cast(kind)).when(T.contains_any(option, words) & (F.size(doc_scope) >= 2), each.cast(kind)).otherwise(F.array().cast(kind))


def structured_fields(text: Column) -> Column:
    """Years, first twelve numbers, modal, deadline, and a rule's key and value, as a struct."""
    modal = F.lit(None).cast("string")
    for m in reversed(MODALS):
        modal = F.when(text.contains(m), m).otherwise(modal)
    none = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        F.array_sort(F.array_distinct(T.find_all(text, T.YEAR))).alias("years"),
        F.slice(T.find_all(text, r"[0-9]+(?:\.[0-9]+)?%?|[0-9]+(?:,[0-9]{3})+(?:\.[0-9]+)?"), 1, 12).alias("numbers"),
        modal.alias("modal"), none(F.translate(F.regexp_extract(text, DEADLINE, 1), " ", "")).alias("deadline"),
        none(F.regexp_extract(text, RULE_KEY, 1)).alias("rule_key"), none(F.regexp_extract(text, RULE_KEY, 2)).alias("rule_value"),
    )


def infer_unit(text: Column) -> Column:
    """The unit that a table's surroundings state."""
    out = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in UNIT_PATTERNS))
    for u in UNITS:
        out = F.coalesce(out, F.when(text.contains(f"单位：{u}") | text.contains(f"单位:{u}"), F.lit(u)))
    return out


def table_name(path: Column, preview: Column, page: Column) -> Column:
    """A name in the text before a table, else its section, else its page."""
    found = [F.nullif(F.regexp_extract(preview, p, 1), F.lit("")) for p in (r"表\s*[0-9]+[:：]?([^\n]{2,40})", r"([\x{4e00}-\x{9fff}]{2,30}(?:表|指标|情况|明细))")]
    parts = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda p: p != "")
    return F.coalesce(*(F.trim(x) for x in found), F.when(F.size(parts) > 0, F.element_at(parts, -1)), F.concat(F.lit("page_"), page.cast("string"), F.lit("_table")))


def temperatures(n: Column) -> Column:
    """Sampling temperatures of n voting rounds."""
    fixed = {1: [0.1], 2: [0.1, 0.4], 3: [0.1, 0.3, 0.5], 5: [0.1, 0.2, 0.3, 0.4, 0.5]}
    out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 0.1 + (0.5 - 0.1) * i / (n - 1))
    for k, values in fixed.items():
        out = F.when(n == k, F.array(*map(F.lit, values))).otherwise(out)
    return out


def pack_queries(keywords: Column, fields: Column, known: dict[str, str] = FIELD_QUERIES, default: str = DEFAULT_FIELD_QUERY) -> Column:
    """Queries of a field pack: its keywords, or all fields' texts if there are none; the first three
    fields' texts; a fixed one if nothing else."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    texts = F.array_compact(F.transform(fields, lambda f: F.try_element_at(table, f)))
    first = F.array_compact(F.transform(F.slice(fields, 1, 3), lambda f: F.try_element_at(table, f)))
    none = F.array().cast("array<string>")
    head = F.when(keywords != "", F.array(keywords)).when(F.size(texts) > 0, F.array(F.array_join(texts, " "))).otherwise(none)
    out = F.concat(head, first)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(default)))


def fallback_packs(text: Column, rules: tuple = FALLBACK_RULES, sections: list[str] = FALLBACK_SECTIONS) -> Column:
    """struct<fields, sections, keywords>: what keyword rules find in a question and its options; sets in
    alphabetical order, at most 15 keywords."""
    none = F.array().cast("array<string>")

    def gather(at: int) -> Column:
        return F.concat(none, *(F.when(T.contains_any(text, r[0]), _strings(r[at])).otherwise(none) for r in rules))

    fields, keywords = gather(2), gather(1)
    words = F.slice(F.split(F.trim(text), r"\s+"), 1, 10)
    each = lambda c: F.array_sort(F.array_distinct(c))
    return F.struct(
        F.when(F.size(fields) > 0, each(fields)).otherwise(F.array(F.lit("general"))).alias("fields"),
        each(F.concat(_strings(sections), gather(3))).alias("sections"),
        F.array_join(F.slice(each(F.when(F.size(fields) > 0, keywords).otherwise(words)), 1, 15), " ").alias("keywords"),
    )


def evidence_gaps(questions: DataFrame, texts: DataFrame, rules: dict[str, tuple[list[str], str, list[str]]]) -> DataFrame:
    """Questions (qid, doc_ids, text) that mention a field for which a document's evidence (qid, doc_id, text) holds none
    of the field's words: (qid, doc_id, field, query)."""
    table = F.array(*(F.struct(F.lit(k).alias("field"), _strings(words).alias("words"), F.lit(q).alias("query")) for k, (words, q, _) in rules.items()))
    asked = questions.select("qid", F.explode("doc_ids").alias("doc_id"), "text", F.explode(table).alias("r")).where("contains(text, r.field)")
    held = texts.select("qid", "doc_id", F.col("text").alias("evidence"))
    joined = asked.join(held, ["qid", "doc_id"], "left")
    return joined.where(~F.exists("r.words", lambda w: F.contains(F.coalesce("evidence", F.lit("")), w))).select("qid", "doc_id", "r.field", "r.query")
