"""Chat, mail, document and stream sources on small files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pages
from corpusloom.sources import chat, files, mail


def chats(spark, tmp_path, body, author="Ana Paz", **more):
    (tmp_path / "chat.txt").write_text(body, encoding="utf-8")
    lines = chat.read_lines(spark, str(tmp_path / "chat.txt"))
    return [r.text for r in chat.messages(lines, author, mask=False, **more).orderBy("pos").collect()]


LONG = "a message that is surely long enough to stay"


def test_chat_formats(spark, tmp_path):
    body = f"﻿[3/1/24, 9:15:02 p. m.] Ana Paz: {LONG}\r\n3/1/24, 21:16 - ANA PAZ: second {LONG}\n‎[3/1/24, 9:17:00 PM] ‎Beto: {LONG}\n"
    assert chats(spark, tmp_path, body) == [LONG, f"second {LONG}"]


def test_chat_messages(spark, tmp_path):
    body = f"3/1/24, 10:00 - Ana Paz: first {LONG}\ngoes on\n\nand on\n3/1/24, 10:01 - Ana Paz: short\n3/1/24, 10:02 - Ana Paz: <Multimedia omitido> {LONG}\nstray\n3/1/24, 10:03 - Beto: {LONG}\nhis line\n3/1/24, 10:04 - ana paz: last {LONG}"
    assert chats(spark, tmp_path, body) == [f"first {LONG} goes on and on", f"last {LONG}"]
    counted = chat.match_rate(chat.read_lines(spark, str(tmp_path / "chat.txt"))).first()
    assert (counted.total_lines, counted.matched_lines) == (10, 5)
    assert chats(spark, tmp_path, "no message at all\n") == []


OWN = "This is the body of a mail, which is long enough to be kept, as it has over a hundred characters in its only line."


def box(*mails):
    return "".join(f"From x Mon Jan 1 00:00:00 2024\n{m}\n\n" for m in mails)


def read(spark, tmp_path, text, sender="ann@example.org"):
    (tmp_path / "b.mbox").write_text(text, encoding="utf-8")
    return mail.mails(mail.read_mbox(spark, str(tmp_path / "b.mbox")), sender).collect()


def test_mail(spark, tmp_path):
    plain = f"From: Ann <ann@example.org>\nSubject: =?utf-8?q?Caf=C3=A9?=\nContent-Type: text/plain; charset=utf-8\n\n{OWN}\n\n"
    got = read(
        spark,
        tmp_path,
        box(
            plain + "On Mon, Bob <b@example.org> wrote:\n> quoted",
            plain.replace("Ann <ann", "Ann <joann"),
            plain.replace("Subject:", "X-Gmail-Labels: Inbox\nSubject:"),
            plain.replace("Subject:", "X-Gmail-Labels: Enviado,Inbox\nSubject:") + "El lunes, Beto escribió:\nalgo",
            plain.replace("=?utf-8?q?Caf=C3=A9?=", "Our Newsletter"),
            "From: ANN@example.org\nSubject: s\nContent-Type: text/plain\n\nshort",
            f"From: ann@example.org\nSubject: html\nContent-Type: text/html\n\n<p>{OWN}</p>\n-- \nsig",
            f'From: ann@example.org\nSubject: both\nContent-Type: multipart/alternative; boundary="q"\n\n--q\nContent-Type: text/plain\n\n{OWN} plain\n--q\nContent-Type: text/html\n\n<p>{OWN} html</p>\n--q--',
        ),
    )
    assert sorted((r.subject, r.text) for r in got) == [("Café", OWN), ("Café", OWN), ("both", OWN + " plain"), ("html", OWN)]
    assert {r.register for r in got} == {"email_prof"}


def test_mail_headers():
    assert mail.decode_header(None) == "" and mail.decode_header("=?iso-8859-1?q?a=F1o?=") == "año"


def test_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('One')}{p(' ')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Two')}</w:body></w:document>"
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "x.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "y.pdf").write_bytes(b"page one|page two")
    got = files.read_documents(spark, str(tmp_path), pdf=lambda b: b.decode().split("|"))
    rows = {(r.source.rsplit("/", 1)[1], r.page_no): r.text for r in got.filter("error IS NULL").collect()}
    assert rows == {("x.docx", 0): "One\nTwo\na | b", ("y.pdf", 0): "page one", ("y.pdf", 1): "page two"}
    assert tuple(files.file_counts(got).first()) == (2, 1)


def test_page_lines(spark):
    seven = [("d", i, f"My Report\n{i}\nline {i} of text\nReferences\nnot this") for i in range(7)]
    df = spark.createDataFrame(seven + [("s", 0, "My Report\nx"), ("s", 1, "My Report\ny")], "source string, page_no int, text string")
    clean = df.withColumn("text", pages.clean_page("text"))
    out = {(r.source, r.page_no): r.text for r in pages.drop_repeated(clean).collect()}
    assert out[("d", 3)] == "line 3 of text" and out[("s", 1)] == "My Report\ny"
    three = spark.createDataFrame([("t", i, f"only {i}") for i in range(3)], "source string, page_no int, text string")
    assert {r.text for r in pages.drop_repeated(three).collect()} == {""}
    assert {r.text for r in pages.drop_repeated(three, threshold=0.5).collect()} == {"only 0", "only 1", "only 2"}


def test_document_chunks(spark):
    body = " ".join(f"word{i}" for i in range(500))
    df = spark.createDataFrame([("a", 0, body), ("b", 0, body), ("c", 0, "too short")], "source string, page_no int, text string")
    got = sorted((r.source, r.chunk_no) for r in pages.chunks(df).collect())
    assert got == [("a", 0), ("a", 1)]


def test_jsonl_and_prompts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"x","register":"casual","original_text":"é"}\n\n{"text":"y","register":"odd","original_text":"z"}\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_test_texts(spark, str(tmp_path / "a.jsonl")).collect()] == [("casual", "é")]
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):  # noqa: B017  the reader's own error
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "text string").collect()
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "text string", strict=False).first()["_corrupt_record"] == "{nope"
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "casual.txt").write_text("  one \n\n two\n")
    assert [tuple(r) for r in files.read_prompts(spark, str(tmp_path / "prompts")).orderBy("pos").collect()] == [("casual", 0, "one"), ("casual", 1, "two")]


def test_streams(spark):
    lines = ['{"response":"a","done":false}', "", "bad", '{"response":"b","done":false}', '{"done":true,"eval_count":7}', '{"response":"late"}']
    df = spark.createDataFrame([(1, i, l) for i, l in enumerate(lines)], "call int, pos int, line string")
    got = [(r.token, r.done, r.eval_count) for r in files.ndjson_tokens(df, "call", "pos", "line").orderBy("pos").collect()]
    assert got == [("a", False, None), ("b", False, None), ("", True, 7)]
    body = 'data: {"token":"x"}\nevent: e\ndata: {oops\ndata: {"token":"y"}\ndata: [DONE]\ndata: {"token":"z"}\n'
    s = spark.createDataFrame([(body,), ('data: {"token":"x"}\ndata: {"tok',), ("",)], "b string")
    assert [r[0] for r in s.select(files.sse_tokens("b")).collect()] == [["x", "y"], ["x"], []]
    e = spark.range(1).select(files.sse_event(F.lit("t"), F.lit(False), F.lit(1), F.lit(2.0)).alias("e"))
    assert e.first().e == 'data: {"token":"t"}\n\n'
    assert files.model_names('{"models":[{"name":"m:1"}]}') == ["m:1"]


def test_documents_go_out_in_batches(spark):
    df = spark.createDataFrame([(f"{i}.docx", bytearray(files.docx_bytes(f"text {i}") if i % 7 else b"damaged")) for i in range(50)], "path string, content binary").coalesce(1)
    out = files.extract_documents(df)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.source: (r.page_no, r.text, r.error is None) for r in out.collect()}
    assert rows == {f"{i}.docx": (0, f"text {i}", True) if i % 7 else (None, None, False) for i in range(50)}
