"""Built-in folding against NFKC of the standard library, on all assigned characters and all combining pairs."""

import unicodedata

from fogbank.functions.text import _BLANKS, _COMPOSED, cell_text


def test_folding_equals_nfkc(spark):
    points = [chr(p) for p in range(0x20, 0x323B0) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    texts = [f"-{c}y" for c in points] + [f"-{pair}y" for pair in _COMPOSED] + ["Ａ\u0300 ｶﾞ e\u0301te\u0301", "𝐀𝟗 ℃ ㍿"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cell_text("t").alias("f")).collect()
    want = {i: unicodedata.normalize("NFKC", t).replace("\n", "").replace("\r", "").strip(_BLANKS) for i, t in enumerate(texts)}
    wrong = [texts[r["i"]] for r in rows if r["f"] != want[r["i"]]]
    assert len(rows) == len(texts) and not wrong, (len(wrong), wrong[:20])
    assert len(_COMPOSED) > 900
