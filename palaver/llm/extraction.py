"""The main text of web pages, by boosted trees over the features of their nodes.

The trees give each node (block element or run of text) the log-odds that it holds text of the article; the choice over the
whole tree is then the best one in which no node belongs without its parent (see ``Page.decode``). They are trained here, on
``TRAIN_PAGES`` pages that ``page_samples`` writes by rule; no page of the input is a training page.

A quarter of the training pages have class names that tell nothing, and some are in other scripts.

Defined results: a null or empty page has the empty text; markup that is never closed or opened is passed over, and what a
tag, quote, comment or script leaves open ends with the page; a very long page is one page and takes time in proportion;
repeated rows, and rows that share an id, are extracted each; other columns aren't read; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .dom import Page
from .page_samples import Writer

TRAIN_PAGES = 1200
#: Pages whose nodes are scored at once.
PAGES = 256


def labelled(page: Page, texts: list[str]) -> np.ndarray:
    """Which nodes hold a text of the article: the runs with these texts, in their order, and all above them."""
    y, k = np.zeros(len(page.tag), bool), 0
    for i, t in enumerate(page.text):
        if t and k < len(texts) and t == texts[k]:
            k += 1
            while i >= 0 and not y[i]:
                y[i] = True
                i = page.parent[i]
    return y


@cache
def trained(pages: int = TRAIN_PAGES, seed: int = 5) -> BoostedTrees:
    x, y = [], []
    for s in range(pages):
        source, texts = Writer(seed * 1_000_003 + s).page()
        page = Page(source)
        x.append(page.features())
        y.append(labelled(page, texts))
    weight = np.concatenate([np.full(len(v), 40.0 / max(40, len(v))) for v in y])
    return BoostedTrees(np.concatenate(x), np.concatenate(y).astype(float), weight)


def main_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [p.features() for p in pages]
    margins = model.margins(np.concatenate(rows)) if rows else np.zeros(0)
    at = np.cumsum([0, *map(len, rows)])
    return [" ".join(p.decode(margins[i:j])) for p, i, j in zip(pages, at[:-1], at[1:], strict=True)]


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                texts = main_texts([s or "" for s in part.column(2).to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
