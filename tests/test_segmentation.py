"""Order-dependent operators against plain Python written from their rules."""

import random
import re

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.vocab import CHINESE
from gleanery.operators import parsing
from gleanery.operators import segmentation as S


def slow_paths(headings):
    stack, out = [], []
    for level, title in headings:
        kept = [(a, b) for a, b in stack if a < level]
        if kept and kept[-1][1] == title:
            stack = kept
        elif not any((a, b) == (level, title) for a, b in stack[-2:]):
            stack = [*kept, (level, title)]
        out.append(" > ".join(t for _, t in stack if t))
    return out


def test_section_tree(spark):
    rng = random.Random(2)
    docs = {d: [(rng.randrange(1, 4), rng.choice("abc")) for _ in range(rng.randrange(1, 30))] for d in range(60)}
    rows = [(d, i, lv, t) for d, hs in docs.items() for i, (lv, t) in enumerate(hs)]
    got = S.section_tree(spark.createDataFrame(rows, "doc_id bigint, ord bigint, level int, title string"), "doc_id").collect()
    want = {(d, i): p for d, hs in docs.items() for i, p in enumerate(slow_paths(hs))}
    assert {(r["doc_id"], r["ord"]): r["path"] for r in got} == want


def test_text_units(spark):
    rng = random.Random(5)
    docs = {d: ["x" * rng.choice([0, 5, 300, 700, 1200]) for _ in range(rng.randrange(1, 25))] for d in range(40)}
    want = {}
    for d, lines in docs.items():
        unit, held, parts = 0, 0, []
        for line in lines:
            if held > 1100:
                want[d, unit] = parts
                unit, held, parts = unit + 1, 0, []
            held = held + len(line) + (1 if held > 0 else 0) if parts else len(line)
            parts.append(line)
        want[d, unit] = parts
    rows = [(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)]
    got = S.text_units(spark.createDataFrame(rows, "doc_id bigint, ord bigint, line string"), "doc_id").collect()
    assert {(r["doc_id"], r["unit"]): r["text"] for r in got} == {k: "\n".join(v) for k, v in want.items() if len("".join(v)) >= 8}


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(1650))
    got = S.fixed_chunks(spark.createDataFrame([(1, 0, text), (1, 1, "short"), (2, 0, "")], "d bigint, seq int, t string"), "d", "t", 800, 100, "seq").orderBy("d", "chunk_id").collect()
    assert [(r["d"], r["chunk_id"], r["start"], len(r["chunk"])) for r in got] == [(1, 0, 0, 800), (1, 1, 700, 800), (1, 2, 1400, 250), (1, 3, 0, 5), (2, 0, 0, 0)]


def test_tables_and_cards(spark):
    cells = spark.createDataFrame([("t", 0, ["项目", "2024年", "2024年"]), ("t", 1, ["", "调整前", "调整后"]), ("t", 2, ["营业收入", "1", "2"]), ("u", 0, ["a", "b", "b"]), ("u", 1, ["r", "1", "2"])], "t string, row int, cells array<string>")
    got = {(r["t"], r["row_header"]): r["values"] for r in S.table_units(cells, "t").collect()}
    assert got[("t", "营业收入")] == {"2024年/调整前": "1", "2024年/调整后": "2"} and got[("u", "r")] == {"b": "2"}
    units = spark.createDataFrame([(1, 0, "主要会计数据", "2024 2023 营业收入 10 9 8", None, "万元"), (1, 1, "主要会计数据", "2024 2023 营业收入 10 9 8", None, None), (1, 2, "x", "nothing", None, None)], "doc_id bigint, ord bigint, section_path string, text string, row_header string, unit string")
    cards = S.field_cards(units, CHINESE.metrics, CHINESE.section_priors).collect()
    assert len(cards) == 1 and cards[0]["value_map"] == {"2024": "10", "2023": "9", "v1": "8"} and cards[0]["confidence"] == 0.68


def test_header_rows(spark):
    tables = {"year": (["项目", "x"], ["", "2023"]), "adjusted": (["项目", "1"], ["", "调整后"]), "plain": (["a", "b"], ["c", "d"]), "valued": (["a", "b"], ["c", "5"]), "first": (["a", "7"], ["c", "d"])}
    cells = spark.createDataFrame([(t, i, r) for t, two in tables.items() for i, r in enumerate([*two, ["row", "9"]])], "t string, row int, cells array<string>")
    got = {t: sorted(r["row"] for r in S.table_units(cells, "t").collect() if r["t"] == t) for t in tables}
    assert {t: len(rows) for t, rows in got.items()} == {"year": 1, "adjusted": 1, "plain": 1, "valued": 2, "first": 2}


def test_toc(spark):
    rows = [(1, 1, i, x) for i, x in enumerate(["目录", "第一节 释义", "3", "第二节 公司", "5", "一、概况", "7", "二、情况", "9"])]
    lines = spark.createDataFrame(rows, "doc_id bigint, page bigint, ord bigint, line string")
    assert S.toc_pages(lines, "doc_id", "page").count() == 1
    got = [(r["title"], r["page"]) for r in S.toc_entries(lines.drop("page"), "doc_id").orderBy("ord").collect()]
    assert got[0] == ("第一节 释义", 3) and ("二、情况", 9) in got


def test_regulatory(spark):
    text = ["第一章 总则", "第一条 甲", "第一节 节", "第二条 乙", "正文", "第二章 分则", "正文"]
    got = S.regulatory_sections(spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id bigint, ord bigint, line string"), "doc_id").orderBy("ord").collect()
    assert [(r["chapter"], r["section"], r["article"]) for r in got] == [
        ("第一章 总则", None, None), ("第一章 总则", None, "第一条"), ("第一章 总则", "第一节 节", None), ("第一章 总则", "第一节 节", "第二条"),
        ("第一章 总则", "第一节 节", "第二条"), ("第二章 分则", None, None), ("第二章 分则", None, None)]


def test_field_lines(spark):
    page = ["前言", "营业收入", "2024年", "1,234.5万元", "第一节 其他", "总资产 99亿元", "利润总额", "没有数字的一段非常非常长的说明文字超过二十二个字符", "现金分红 本年不实施分配"]
    rows = [(1, 1, i, x) for i, x in enumerate(page)]
    got = parsing.field_lines(spark.createDataFrame(rows, "doc_id bigint, page bigint, ord bigint, line string"), CHINESE.metrics).orderBy("ord").collect()
    assert [(r["ord"], r["metric"]) for r in got] == [(1, "营业收入"), (5, "总资产"), (8, "现金红利")]
    assert got[0]["text"] == "营业收入；2024年；1,234.5万元"


def by_hand(page, metrics, ahead=9):
    """Units of a page of lines, as the rules say: (place, raw metric, text)."""
    names = sorted({a for al in metrics.values() for a in al}, key=len, reverse=True)
    metric, value, year = re.compile("|".join(names)), re.compile(T.VALUE), re.compile("20[0-9]{2}")
    free, out = 0, []
    for at, line in enumerate(page):
        named = metric.search(line)
        if not named or at < free:
            continue
        taken, stop = [line], min(len(page), at + 1 + ahead)
        for k in range(at + 1, stop):
            x = page[k]
            if x.startswith("第一节") or (k > at + 1 and metric.search(x) and not value.search(x)):
                stop = k
                break
            if x and (value.search(x) or year.search(x) or any(w in x for w in parsing.LABELS) or len(x) <= 22):
                taken.append(x)
        text = "；".join(taken)
        if (value.search(text) or any(w in text for w in parsing.NO_VALUE)) and len("".join(text.split())) >= 8:
            out.append((at, named[0], text))
            free = max(at + 1, stop - 1)
    return out


def test_field_lines_of_random_pages(spark):
    rng = random.Random(11)
    parts = ["营业收入", "总资产 99亿元", "利润总额", "1,234.5万元", "2024年", "第一节 其他", "没有数字的一段非常非常长的说明文字超过二十二个字符", "说明", "", "本年不实施分配", "净利润与利润总额", "12%", "不适用"]
    pages = {d: [rng.choice(parts) for _ in range(rng.randrange(1, 40))] for d in range(80)}
    rows = [(d, 1, i, x) for d, page in pages.items() for i, x in enumerate(page)]
    got = parsing.field_lines(spark.createDataFrame(rows, "doc_id bigint, page bigint, ord bigint, line string"), CHINESE.metrics).collect()
    want = {(d, *u) for d, page in pages.items() for u in by_hand(page, CHINESE.metrics)}
    assert {(r["doc_id"], r["ord"], r["raw_metric"], r["text"]) for r in got} == want and len(got) == len(want) > 100


def test_document_cards(spark):
    pages = spark.createDataFrame([("a", 1, "中国建筑股份有限公司 2024 年度报告"), ("b", 1, "关于招行的文件"), ("b", 2, "年度报告 2023"), ("c", 1, "none")], "doc_id string, page int, text string")
    got = {r["doc_id"]: r for r in parsing.document_cards(pages, CHINESE.companies).collect()}
    assert (got["a"]["company"], got["a"]["year"], got["a"]["title"]) == ("中国建筑股份有限公司", 2024, "中国建筑股份有限公司2024年度报告")
    assert (got["b"]["company"], got["b"]["year"], got["b"]["page_count"]) == ("招商银行股份有限公司", 2023, 2)
    assert got["c"]["title"] == "c"


def test_embedding_batches_fail_alone(spark):
    calls = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(6)], "id bigint, text string").coalesce(1)

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t)), 1.0] for t in texts]

    got = {r["id"]: r["vec"] for r in parsing.embed_texts(calls.orderBy("id"), embed, batch=2, dimension=2, attempts=1).collect()}
    assert got[0] == [2.0, 1.0] and got[2] == got[3] == [0.0, 0.0]


def test_carry_and_keep_first(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None), (1, 3, "b")], "d bigint, o bigint, v string")
    assert [r["c"] for r in S.carry_forward(rows, "d", "o", F.col("v"), "c").orderBy("o").collect()] == [None, "a", "a", "b"]
    assert S.keep_first(rows, ["d"], "o").count() == 1
