import html
from xml.etree import ElementTree as ET

from litscreen.sources.pubmed_xml import parse_pubmed_xml, read_pubmed_xml


def article(pmid="1", title="<ArticleTitle>T</ArticleTitle>", abstract="", authors="", refs="", other=""):
    return (
        f'<PubmedArticle><MedlineCitation Status="X"><PMID Version="1">{pmid}</PMID><Article>'
        f"<Journal><Title>J &amp; K</Title></Journal>{title}{abstract}<AuthorList>{authors}</AuthorList></Article>"
        f"{other}</MedlineCitation><PubmedData>"
        f'<ArticleIdList><ArticleId IdType="pubmed">{pmid}</ArticleId></ArticleIdList>{refs}</PubmedData></PubmedArticle>'
    )


def reference(*ids):
    inner = "".join(f'<ArticleId IdType="{kind}">{value}</ArticleId>' for kind, value in ids)
    return f"<Reference><Citation>c</Citation><ArticleIdList>{inner}</ArticleIdList></Reference>"


PAYLOADS = [
    article("1", "<ArticleTitle>A <i>nested <b>tag</b></i>s  title\n here</ArticleTitle>"),
    article("2", "<ArticleTitle>&amp;lt;b&amp;gt; &amp;amp; &amp;eacute; x</ArticleTitle>"),
    article("3", "<ArticleTitle>a &lt; b and c &gt; d</ArticleTitle>"),
    article("4", "<ArticleTitle>beta &#x3b2; &#946;</ArticleTitle>"),
    article("5", "<ArticleTitle/>", '<Abstract><AbstractText/><AbstractText Label="X"/></Abstract>'),
    article("6", "", '<Abstract><AbstractText Label="A">one <sup>2</sup></AbstractText>\n<AbstractText>two</AbstractText></Abstract>'),
    article("7", other="<OtherAbstract><AbstractText>not this</AbstractText></OtherAbstract>"),
    article("8", authors="<Author><LastName>Doe</LastName><Initials>J</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author>"
            "<Author><LastName>Only</LastName></Author><Author><LastName/><Initials>Q</Initials><CollectiveName>Q team</CollectiveName></Author>"),
    article("9", refs="<ReferenceList>" + reference(("pubmed", "11"), ("doi", "10/x")) + reference(("pubmed", "12"), ("pubmed", "11")) + "</ReferenceList>"),
    article("10", refs="<ReferenceList><Title>r</Title><ReferenceList>" + reference(("pubmed", "21")) + "</ReferenceList>" + reference(("pubmed", "22")) + "</ReferenceList>"),
    article("11", "<ArticleTitle><![CDATA[x < y]]> z<!-- no --></ArticleTitle>"),
    article("12", '<ArticleTitle xml:lang="en">AT&amp;T <a href="u"/>rest</ArticleTitle>tail text', "<Abstract><AbstractText>p &amp;nbsp; q</AbstractText></Abstract>"),
    article("13", "<ArticleTitle>O&apos;Neil &quot;q&quot;</ArticleTitle>", "<Abstract><AbstractText> </AbstractText><AbstractText>x</AbstractText></Abstract>"),
    article("14").replace('<PMID Version="1">', "<PMID>"),
]

REJECTED = [
    "<PubmedArticle><MedlineCitation><PMID>90</PMID></MedlineCitation></PubmedArticle>",
    article("91")[:60],
    "no xml at all",
    None,
]


def expected(payload):
    """What the standard library says about one article."""
    root = ET.fromstring(payload)
    citation = root.find("MedlineCitation")
    node = citation.find("Article")

    def text(element):
        return " ".join(html.unescape(ET.tostring(element, method="text", encoding="unicode").strip()).split())

    names = []
    for a in node.findall("AuthorList/Author"):
        if a.findtext("LastName") and a.findtext("Initials"):
            names.append(a.findtext("LastName") + " " + a.findtext("Initials"))
        elif a.findtext("CollectiveName"):
            names.append(a.findtext("CollectiveName"))
    ids = [i.text for r in root.findall(".//ReferenceList/Reference") for i in r.findall(".//ArticleId") if i.get("IdType") == "pubmed"]
    parts = [t for t in map(text, node.findall("Abstract/AbstractText")) if t]
    title = node.find("ArticleTitle")
    return (
        citation.findtext("PMID"),
        "" if title is None else text(title),
        " ".join(parts),
        names,
        node.findtext("Journal/Title") or "",
        ids,
    )


def test_articles_and_rejects(spark):
    df = spark.createDataFrame([(p,) for p in PAYLOADS + REJECTED], "payload string").repartition(3)
    articles, rejected = parse_pubmed_xml(df)
    got = sorted((tuple(row) for row in articles.collect()), key=lambda r: int(r[0]))
    assert got == [expected(p) for p in PAYLOADS]
    assert rejected.count() == len(REJECTED)


def test_file_is_cut_into_articles(spark, tmp_path):
    frame = '<?xml version="1.0"?>\n<PubmedArticleSet>\n{}\n</PubmedArticleSet>\n'
    book = "<PubmedBookArticle><BookDocument><PMID>5</PMID></BookDocument></PubmedBookArticle>"
    (tmp_path / "a.xml").write_text(frame.format("\n".join(PAYLOADS[:3] + [book] + PAYLOADS[3:6])), encoding="utf-8")
    (tmp_path / "b.xml").write_text(frame.format("\n".join(PAYLOADS[6:] + [book])), encoding="utf-8")
    payloads = read_pubmed_xml(spark, str(tmp_path))
    assert sorted(row.payload for row in payloads.collect()) == sorted(PAYLOADS)
