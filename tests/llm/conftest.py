import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.01"
_WORDS = ("alder birch cedar dogwood elm fir gum hazel iris juniper kapok larch maple nutmeg oak pine "
          "quince rowan spruce teak umbrella vine willow yew zelkova amber basil clove dill fennel").split()


def prose(seed: int, n: int) -> str:
    """``n`` words that repeat seldom, from a linear rule."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(_WORDS[(x >> 8) % 30] + _WORDS[(x >> 16) % 30])
    return " ".join(out)


def edge_texts() -> list[str | None]:
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    return [
        None, "", "   \n\t ", "word", "two words", "123 456 !!", base, base, near, far, base.upper(),
        prose(3, 30) + "\n" + passage + " " + prose(4, 30), passage + " " + prose(5, 20), prose(6, 5) + " " + passage,
        "mail a.b+c@d-e.example.org, ip 10.0.0.255 or 300.1.1.1, card 4111 1111 1111 1111 and 4111111111111112, "
        "call +1 (555) 010-9999 now; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
        "the the the the the the\n" * 20, "#### $$$$ | | | <a> & %%", "Ünïcödé straße " * 70, "x\x1cy <|endoftext|> don't 12.5",
        ("la la la " * 3000) + prose(7, 3000), prose(8, 400) + " " + prose(8, 400), "a" * 5000,
        "item short one", "An item short one here", prose(9, 9), "a@b.c@d.e +1234567 +12 34 56 78 9 1.2.3.4.5.6.7.8",
    ]


def write_tables(folder, texts, ids=None, extra=True) -> str:
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    langs = [None if i % 7 == 3 else "en" if i % 2 else "fr" for i in range(n)]
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()),
            "lang": pa.array(langs, pa.string()),
            "source": pa.array([None if i % 5 == 0 else "src0" for i in range(n)], pa.string()),
            "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
    if extra:  # names that operators use inside
        for c in ("rid", "n", "bits", "score", "kept", "start", "length", "places", "label", "token", "w", "_counts", "spans"):
            docs[c] = pa.array([i % 3 for i in range(n)], pa.int64())
    pq.write_table(pa.table(docs), f"{folder}/documents.parquet")
    items = {"item_id": pa.array([1, 2, 3, 10, None], pa.int64()),
             "text": pa.array([prose(2, 60), "item short one", None, prose(2, 60), ""], pa.string())}
    pq.write_table(pa.table(items if n else {k: v[:0] for k, v in items.items()}), f"{folder}/benchmark.parquet")
    labels = {"doc_id": pa.array(ids[::2], pa.int64()),
              "quality": pa.array([None if i % 5 == 4 else i % 2 for i in range(len(ids[::2]))], pa.int32()),
              "toxic": pa.array([0] * len(ids[::2]), pa.int32())}
    pq.write_table(pa.table(labels), f"{folder}/labels.parquet")
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.com/de/", "http://x.org/fr/1",
            "https://badnet/", "http://net", "http://net/", "http://a.net?q=/en/", "ftp://example.com.:80/de/é#f",
            "x://y://example.com/de/", "http://example.com/de/"]
    pages = {"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()),
             "html": pa.array([None] * len(urls), pa.string()), "host": pa.array(["x"] * len(urls))}
    pq.write_table(pa.table(pages if n else {k: v[:0] for k, v in pages.items()}), f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    texts = edge_texts()
    ids = [*range(len(texts) - 3), len(texts) - 3, None, 6]  # a null id and a repeated row
    texts[-1] = texts[6]
    return write_tables(tmp_path_factory.mktemp("edge"), texts, ids)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [])
