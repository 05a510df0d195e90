"""Rows made ready to load."""

from studyloom.operators.loads import finalized

SHAPE = "order_num long, title string, chapter string, sub_chapter string, content string, anchor string, failed boolean, sections array<struct<title:string,content:string>>"
BOOK = {"id": "b", "subject": "内科学", "edition": "10"}
LONG = "慢性气道炎症性疾病，表现为喘息和气促。"


def test_rows_are_checked_completed_and_told_apart(spark):
    rows = [
        (0, " 支气管 哮喘 ", "第一篇", " ", LONG, None, None, None), (1, "支气管哮喘", "第一篇", None, LONG + "二", None, False, None), (2, "支气管哮喘", "第一篇", None, LONG, "7", None, None),
        (3, "Extraction Failed", None, None, LONG, None, None, None), (4, "", None, None, LONG, None, None, None), (5, None, None, None, LONG, None, None, None), (6, "短", None, None, "太短", None, None, None),
        (7, "有节", None, "第二章", None, None, None, [("定义", "x")]), (8, "错", None, None, LONG, None, True, None),
    ]
    frame = spark.createDataFrame(rows, SHAPE)
    got = {r.order_num: r for r in finalized(frame, BOOK).collect()}
    assert sorted(got) == [0, 2, 7] and len({r.id for r in got.values()}) == 3 and all(r.id.startswith("kn-") and len(r.id) == 23 for r in got.values())
    assert (got[0].title, got[0].sub_chapter, got[0].knowledge_path) == ("支气管 哮喘", None, ["内科学", "第一篇", "支气管 哮喘"])
    assert [tuple(s) for s in got[0].sections] == [("知识要点", LONG)] and [tuple(s) for s in got[7].sections] == [("定义", "x")]
    assert (got[7].chapter, got[7].sub_chapter, got[2].provenance.source_anchor) == ("未分类", "第二章", "7")
    again = {r.order_num: r.id for r in finalized(frame.repartition(3), BOOK).collect()}
    assert again == {k: r.id for k, r in got.items()}
    placed = {r.order_num: r for r in finalized(frame, BOOK, "第九篇", "第一章").collect()}
    assert (placed[0].chapter, placed[0].sub_chapter, placed[0].provenance.own_chapter) == ("第九篇", "第一章", "第一篇") and placed[0].id != got[0].id
