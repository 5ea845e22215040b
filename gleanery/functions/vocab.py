"""Vocabularies as data. Operators take them as arguments; two sets are given here.

The lists under "fixed values" must equal the ones of the method they reproduce for right
results; the Latin set serves texts without Chinese.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -----------------------------------------------------------
METRIC_ALIASES = {
    "营业收入": ["营业收入", "营业总收入", "营业额", "收入"],
    "利润总额": ["利润总额"],
    "归属于上市公司股东的净利润": ["归属于上市公司股东的净利润", "归母净利润", "母公司拥有人应占溢利", "归属于母公司股东的净利润"],
    "扣非归母净利润": ["归属于上市公司股东的扣除非经常性损益的净利润", "扣非归母净利润", "扣除非经常性损益后的净利润"],
    "经营活动产生的现金流量净额": ["经营活动产生的现金流量净额", "经营现金流", "经营活动现金流量净额", "经营活动现金流"],
    "归属于上市公司股东的净资产": ["归属于上市公司股东的净资产", "归母净资产"],
    "总资产": ["总资产", "资产总计"],
    "总负债": ["负债合计", "总负债"],
    "所有者权益": ["所有者权益", "股东权益"],
    "期末总股本": ["期末总股本", "总股本"],
    "基本每股收益": ["基本每股收益"],
    "稀释每股收益": ["稀释每股收益"],
    "加权平均净资产收益率": ["加权平均净资产收益率", "ROE", "净资产收益率"],
    "研发投入": ["研发投入", "研发费用", "研发经费"],
    "现金红利": ["现金红利", "现金分红", "每10股派", "每 10 股派", "派发现金", "股息", "派息"],
    "资本公积金转增股本": ["资本公积金转增股本", "转增股本", "公积金转增"],
    "送红股": ["送红股", "送股"],
    "新签合同额": ["新签合同额", "新签合同"],
    "合约销售额": ["合约销售额", "销售额"],
    "合约销售面积": ["合约销售面积", "销售面积"],
    "土地储备": ["土地储备"],
    "资产负债率": ["资产负债率"],
    "流动资产": ["流动资产"],
    "非流动资产": ["非流动资产"],
    "流动负债": ["流动负债"],
    "非流动负债": ["非流动负债"],
    "发行规模": ["发行规模", "发行金额", "注册金额"],
    "利率": ["利率", "票面利率"],
    "到期日": ["到期日"],
    "起息日": ["起息日"],
}
COMPANY_ALIASES = {
    "中国建筑股份有限公司": ["中国建筑股份有限公司", "中国建筑", "中建", "CSCEC"],
    "美的集团股份有限公司": ["美的集团股份有限公司", "美的集团", "美的"],
    "比亚迪股份有限公司": ["比亚迪股份有限公司", "比亚迪", "BYD"],
    "宁德时代新能源科技股份有限公司": ["宁德时代新能源科技股份有限公司", "宁德时代", "CATL"],
    "中国移动有限公司": ["中国移动有限公司", "中国移动"],
    "招商银行股份有限公司": ["招商银行股份有限公司", "招商银行", "招行"],
}
SECTION_PRIORS = ["主要会计数据", "主要财务指标", "管理层讨论与分析", "财务报告", "利润分配", "重要提示", "董事会报告", "债券相关", "分季度", "现金流量表", "资产负债表", "利润表", "股东情况"]
DOMAIN_KEYWORDS = {
    "financial_reports": (1.0, ["营业收入", "归母净利润", "扣非", "净利润", "现金流", "研发投入", "研发费用", "分红", "每股", "同比", "环比", "资产负债率"]),
    "regulatory": (1.2, ["总则", "适用范围", "应当", "可以", "不得", "例外", "处罚", "报告", "核实", "差异", "存量", "施行", "期限", "监管", "管理", "义务"]),
    "insurance": (1.1, ["保险责任", "责任免除", "等待期", "犹豫期", "给付", "退保", "现金价值", "受益", "合同解除", "身故", "疾病", "赔付", "免责"]),
    "financial_contracts": (1.0, ["发行", "募集资金", "评级", "回售", "赎回", "违约", "担保", "期限", "票面", "到期", "本金", "利息", "条款"]),
    "research": (0.8, ["结论", "图", "表", "趋势", "预测", "行业", "公司", "同比", "环比", "销售", "收入", "利润", "毛利率", "增长"]),
}
GENERIC_TERMS = ["目录", "封面", "声明", "致辞", "前言", "附录", "索引"]
DOMAIN_CARD_PATTERNS = {
    "financial_reports": {"MetricYearCard": ["营业收入", "净利润", "现金流量", "研发投入", "资产负债率", "同比"], "DividendCard": ["分红", "派息", "现金红利", "每10股", "每股"], "CompareCard": ["增长", "下降", "增加", "减少", "同比", "较上年"]},
    "financial_contracts": {"BondTermCard": ["发行人", "发行规模", "发行金额", "期限", "票面利率", "债券评级", "主体评级"], "PartyRoleCard": ["主承销商", "受托管理人", "评级机构", "簿记管理人", "律师事务所"], "ClauseCard": ["信息披露", "违约", "赎回", "回售", "担保", "偿债保障"]},
    "insurance": {"BenefitRuleCard": ["保险金", "保险责任", "给付", "赔付", "身故", "重大疾病", "医疗"], "ExclusionCard": ["责任免除", "不承担", "不予赔付", "除外", "免责"], "SurrenderRuleCard": ["退保", "现金价值", "账户价值", "退保费用", "犹豫期"], "ClaimCalcCard": ["免赔额", "赔付比例", "报销", "已交保费", "基本保险金额"]},
    "regulatory": {"ArticleCard": ["第", "条", "办法", "规定", "条例", "施行"], "ObligationCard": ["应当", "不得", "可以", "金融机构", "监管", "提交", "保存"], "DeadlineCard": ["日内", "工作日", "年内", "施行", "期限", "保存"], "ExceptionCard": ["除外", "但是", "但", "另有规定", "不适用"]},
    "research": {"ForecastMetricCard": ["预计", "预测", "有望", "目标价", "市场规模", "增速"], "MarketSizeCard": ["市场规模", "CAGR", "复合增速", "渗透率", "亿元", "亿美元"], "CompanyCompareCard": ["同比", "营收", "净利润", "公司", "行业", "对比"]},
}
RISK_KEYWORDS = {
    "universal": ["均", "全部", "所有", "都"],
    "negation": ["不", "未", "无", "没有", "不实施", "不送", "不派", "拟不", "暂不"],
    "threshold": ["超过", "低于", "不超过", "不少于", "高于", "至少", "不低于"],
    "comparison": ["同比增长", "同比下降", "环比", "增长率", "下降"],
    "calculation": ["合计", "总额", "占比", "比例", "之和"],
}
NEGATION_PAIRS = [("未实施", "实施了"), ("不实施", "实施"), ("不送", "送"), ("不派", "派"), ("未", "已"), ("不", ""), ("无", "有"), ("均", "并非全部"), ("全部", "部分"), ("所有", "部分"), ("超过", "未超过"), ("低于", "高于"), ("不超过", "超过")]
PROXY_TERMS = {
    "insurance": ["保险责任", "责任免除", "等待期", "给付", "赔付", "身故", "现金价值", "退保", "领取", "豁免", "保费", "保险金", "免责"],
    "regulatory": ["应当", "可以", "不得", "禁止", "除外", "但是", "前款", "期限", "监管", "报告", "处罚", "职责", "适用", "义务", "决定"],
    "financial_contracts": ["发行人", "发行规模", "发行金额", "注册金额", "评级", "期限", "利率", "回售", "赎回", "担保", "受托管理人", "募集资金", "违约", "主承销商"],
    "financial_reports": ["营业收入", "归母净利润", "扣非", "净利润", "现金流", "研发投入", "研发费用", "分红", "每股", "每10股", "同比", "增长", "下降", "资产负债率"],
    "research": ["行业", "公司", "同比", "环比", "CAGR", "预测", "假设", "结论", "图", "表", "趋势", "增长", "下降", "市场份额"],
}
STOP_TERMS = ["以下", "下列", "关于", "描述", "正确", "错误", "文档", "第一", "第二", "其中", "基于", "根据", "提供", "的是", "是否", "均为", "均是", "哪些"]
ROUTE_PRIORS = {
    "financial_reports": ["主要财务指标", "财务指标", "分红", "研发", "现金流", "利润", "收入"],
    "regulatory": ["总则", "监督管理", "信息披露", "法律责任", "处罚", "报告", "监管", "规则"],
    "insurance": ["保险责任", "责任免除", "等待期", "给付", "现金价值", "退保"],
    "financial_contracts": ["发行条款", "发行", "评级", "募集资金", "违约", "回售", "赎回"],
    "research": ["结论", "图", "表", "趋势", "行业", "公司", "预测"],
}
QID_PREFIXES = {"ins_": "insurance", "reg_": "regulatory", "fc_": "financial_contracts", "fin_": "financial_reports", "res_": "research"}
TOKEN_BUDGET = 5_000_000
# ---- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """What the text operators look for."""

    metrics: dict[str, list[str]]
    companies: dict[str, list[str]]
    section_priors: list[str]
    domain_keywords: dict[str, tuple[float, list[str]]]
    generic_terms: list[str]
    card_patterns: dict[str, dict[str, list[str]]]
    risk: dict[str, list[str]]
    negations: list[tuple[str, str]]
    proxy_terms: dict[str, list[str]]
    stop_terms: list[str] = field(default_factory=list)
    route_priors: dict[str, list[str]] = field(default_factory=dict)


CHINESE = Vocabulary(METRIC_ALIASES, COMPANY_ALIASES, SECTION_PRIORS, DOMAIN_KEYWORDS, GENERIC_TERMS, DOMAIN_CARD_PATTERNS, RISK_KEYWORDS, NEGATION_PAIRS, PROXY_TERMS, STOP_TERMS, ROUTE_PRIORS)
LATIN = Vocabulary(
    metrics={"licence": ["License", "Licensed", "licensed"], "secret": ["token", "="], "table": ["|"], "shout": ["!!", "###"], "mail": ["@"]},
    companies={"Apache": ["Apache", "MIT"], "GNU": ["GNU", "Creative", "CC BY"]},
    section_priors=["The and", "And the", "Enmentai"],
    domain_keywords={"en": (1.0, ["the ", "tion", "ing ", "License"]), "fr": (1.2, ["eau", "tion", "de la"]), "de": (1.1, ["ung", "der ", "keit"]), "es": (0.8, ["ción", "osta", "de "])},
    generic_terms=["###", "%%%", "!!"],
    card_patterns={"en": {"RightsCard": ["License", "licensed"], "SecretCard": ["token", "@"], "ListCard": [" | "]}, "fr": {"RightsCard": ["License"], "WaterCard": ["eauque", "eauou"]}, "de": {"UnitCard": ["ungkeit", "keitung"]}, "es": {"ActionCard": ["ciónmente", "mente"]}},
    risk={"universal": ["all", "every", "the "], "negation": ["not", "no ", "nicht", "pas "], "threshold": ["over", "under", "ver"], "comparison": ["more", "less", "que "], "calculation": ["sum", "total", "ción"]},
    negations=[("not", "indeed"), ("nicht", "doch"), ("pas ", ""), ("the", "no"), ("que", "ne que"), ("ung", "los")],
    proxy_terms={"en": ["License", "token", "stupid", "thing"], "fr": ["eau", "elle"], "de": ["ung", "lich"], "es": ["ción", "mente"]},
    stop_terms=["the", "and", "of"],
    route_priors={"en": ["License", "Then"], "fr": ["Les"], "de": ["Der"], "es": ["Los"]},
)
