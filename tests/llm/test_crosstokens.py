import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from speechtables.llm import crosstokens
from tests.llm.helpers import documents, odd_texts

READ = "/root/testdata/sf0.001/documents.parquet"


def token_bytes(texts):
    """Per text the (id, bytes) lists of both encoders, by the libraries that the files are made for."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter = crosstokens._letters()
    name = {i: t for t, i in whole.get_vocab().items()}
    for text in texts:
        a = [(i, bytes(letter[c] for c in name[i])) for i in whole.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in model.encode(text):
            piece = model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
        yield a, b


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts):
    per_doc = []
    for text, (a, b) in zip(texts, token_bytes([t or "" for t in texts])):
        joined = [b"".join(raw for _, raw in x) for x in (a, b)]
        if not text or joined != [(" " + text).encode()] * 2:
            per_doc.append(None)
            continue
        a, b = spans(a), spans(b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for hi in ends:
            part = ["|".join(",".join(str(i) for i, s, e in x if lo <= s and e <= hi) for x in (a, b))]
            groups += part
            lo = hi
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        per_doc.append((len(a), len(b), groups, links))
    count = Counter(pair for d in per_doc if d for pair in set(d[3]))
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for d in per_doc:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = d
            best = sum(count[p] == highest[p[0]] for p in links)
            out.append((a, b, len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(found):
    assert found.columns == ["doc_id", *COLUMNS]
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, *[r[c] for c in COLUMNS]) for r in found.collect()))


def test_against_all_spans(spark):
    texts = [*odd_texts(), "▁ piece mark", "  two blanks  ", "tab\tand \x00 nul", "<s> </s> <unk> <0x41>", "á ﬁ ½", "same words here", "same words here"]
    ids = [None, *range(1, len(texts) - 1), 5]
    expected = sorted((i if i is not None else -1, *row) for i, row in zip(ids, plain(texts)))
    frame = documents(spark, texts, extra="chunk", ids=ids).withColumnRenamed("n_chars", "n_a")
    for options in ({}, {"chunk_tokens": 50, "memo": 3}):
        assert rows(crosstokens.alignments(frame.repartition(5), **options)[0]) == expected
    assert any(r[1] == 0 and r[7] == "" for r in expected) and any(r[1] > 0 for r in expected)


def test_documents_table(spark):
    table = spark.read.parquet(READ)
    given = table.orderBy("doc_id").select("doc_id", "text").collect()
    expected = sorted((r["doc_id"], *row) for r, row in zip(given, plain([r["text"] for r in given])))
    assert rows(crosstokens.alignments(table, chunk_tokens=4000)[0]) == expected


def test_no_rows(spark):
    found, counts = crosstokens.alignments(documents(spark, []))
    assert rows(found) == [] and counts.count() == 0
