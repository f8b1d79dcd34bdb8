from pathlib import Path

from cragline.llm import license_texts
from cragline.llm.licenses import license_digests, scan_licenses


def test_full_texts_and_titles_are_known(spark):
    mit = license_texts.LICENSES["MIT"]
    texts = {f"{p.stem}-only" if p.stem[:3] in ("GPL", "LGP", "GFD") else p.stem: p.read_text(encoding="utf-8") for p in (Path(license_texts.__file__).parent / "texts").glob("*.txt")}
    docs = list(texts.items()) + [("MIT", mit.replace("MIT License", "The MIT License (MIT)\n\nCopyright (c) 2020 A", 1)), ("MIT", mit.split("\n", 1)[1])]
    docs += [("Apache-2.0", texts["Apache-2.0"].split("APPENDIX")[0]), (None, texts["Apache-2.0"] + " more")]
    got = scan_licenses(spark.createDataFrame([(k, t) for k, t in docs], "doc_id string, text string"), license_digests(spark)).collect()
    assert len(texts) == 15 and len(got) == len(docs) and all(x.doc_id == x.license_id for x in got)
