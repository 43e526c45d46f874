"""Command line: extract, caption, build, ask, chat, evaluate."""

import argparse
import json
import os
import webbrowser
from pathlib import Path

from pyspark.sql import functions as F

from pagewright import rules
from pagewright.models import HashingEmbedder, SentenceModelEmbedder, local_chat, local_vision
from pagewright.operators.command_log import table_view
from pagewright.operators.ordered import number_rows
from pagewright.plans import captions, evaluate as ev, render
from pagewright.plans.ask import ask, Retriever
from pagewright.plans.labelled import LABELLED
from pagewright.plans.ingest import document_chunks, pdf_pages, per_document
from pagewright.plans.store import COMMANDS, KNOWLEDGE, Store, breakdown, prepared, size_profile, stacked
from pagewright.session import local_session, materialize
from pagewright.sources import files as src
from pagewright.sources.pages import page_images
from pagewright.sources.sinks import append_audit, write_csv, write_files
from pagewright.streaming import captioning

CHAT_HELP = """Commands:
  :exit              quit
  :k <number>        number of sources
  :sources on/off    show or hide sources
  :sub <name>|off    force a subsystem, or stop forcing one
  :help              this text"""


def _embedder(name: str):
    return HashingEmbedder() if name == "hashing" else SentenceModelEmbedder(name)


def _part(args, name: str) -> str:
    return os.path.join(args.work, name)


def extract(spark, args) -> None:
    with open(args.registry, encoding="utf-8") as source:
        registry = json.load(source)
    # written once, over what an earlier run left: chunks, pictures and figure context all read these
    pages = pdf_pages(spark, args.input, registry)
    if pages is not None:
        pages.write.mode("overwrite").parquet(_part(args, "pages"))
        pages = spark.read.parquet(_part(args, "pages"))
        pages.where("error IS NOT NULL").select("doc_key", "page", "error").show(truncate=False)
        write_files(page_images(pages), _part(args, "images"))
    chunks, commands = document_chunks(spark, args.input, registry, pages=pages)
    if chunks is not None:
        chunks.write.mode("overwrite").parquet(_part(args, "chunks"))
        per_document(spark.read.parquet(_part(args, "chunks"))).show(truncate=False)
    if commands is not None:
        commands.write.mode("overwrite").parquet(_part(args, "commands"))
    for key, name in registry.items():
        if name.lower().endswith(".docx") and os.path.exists(os.path.join(args.input, name)):
            write_files(src.read_docx_images(src.registered(spark, args.input, {key: name})), _part(args, "images"))


def caption(spark, args) -> None:
    chunks = spark.read.parquet(_part(args, "chunks"))
    state = materialize(src.read_state(spark, _part(args, "caption_state")), "caption-state")
    # context and prompts are worked out once, without the pictures
    pictures = src.read_images(spark, _part(args, "images"))
    pages = src.stored_table(spark, _part(args, "pages"))
    figures = materialize(captions.with_context(pictures.drop("content"), chunks, pages), "figures")
    done, due = captions.done_and_due(figures, state)
    due = captions.prompts(due)
    if args.dry_run:
        listed = due.where("skip is null").select("fname", "doc_key", "page").orderBy("fname")
        for row in (listed.limit(args.limit) if args.limit else listed).toLocalIterator():
            print(*row, sep="\t")
        return
    if args.limit:
        told = captions.caption_figures(due.join(pictures.select("fname", "content"), "fname"), local_vision(), args.limit)
    else:       # a stream, so what is captioned stays when a later batch fails
        runs = _part(args, "caption_runs")
        asked = materialize(due.where("skip is null").select("fname", "prompt"), "prompts")
        captioning.start(captioning.picture_stream(spark, _part(args, "images")), asked, local_vision(), runs).awaitTermination()
        told = captioning.latest(captioning.outcomes(spark, runs)).join(state, "fname", "left_anti")
    told = materialize(told.select("fname", "caption", "error"), "captioned")
    told.where("error is null").select("fname", "caption").write.mode("append").parquet(_part(args, "caption_state"))
    # done and due as they were when the run began; the results as they were written
    captions.run_counts(done, due, told).show()
    state = src.read_state(spark, _part(args, "caption_state"))
    captions.captioned_total(state).show()
    captioned = figures.join(state, "fname")
    names = number_rows(captioned.select("fname"), [], ["fname"], F.substring("fname", 1, 12), "ord")      # list order is by file name
    captions.caption_chunks(captioned.join(names, "fname"), "ord").write.mode("overwrite").parquet(_part(args, "image_captions"))
    captions.write_back(chunks, state).write.mode("overwrite").parquet(_part(args, "chunks_captioned"))


def build(spark, args) -> None:
    store, embedder = Store(spark, _part(args, "store")), _embedder(args.embedder)
    for collection, id_col, names in ((KNOWLEDGE, "chunk_id", ["chunks", "image_captions"]),
                                      (COMMANDS, "record_id", ["commands"])):
        parts = [t for n in names if (t := src.stored_table(spark, _part(args, n))) is not None]
        if not parts:
            continue
        items = stacked(*parts)
        size_profile(items).show()
        breakdown(items).show()
        print(collection, "added", store.load(collection, prepared(items, id_col), embedder, args.reset))
    print(store.counts())


def _retriever(spark, args) -> Retriever:
    return Retriever(Store(spark, _part(args, "store")), _embedder(args.embedder))


def _show(answer, show_sources: bool) -> None:
    print(f"\n{answer.text}\n")
    if answer.table is not None:
        print(render.DAY_HEAD)
        for row in render.day_lines(answer.table).orderBy("nth").toLocalIterator():
            print(row["line"])
    elif show_sources and answer.results is not None:
        print(f"Sources:\n{answer.sources()}")
    for image in answer.images:
        print(f"  {image}")


def open_images(paths: list[str]) -> None:
    """Show figures with this machine's default program."""
    for path in map(Path, paths):
        if path.exists():
            webbrowser.open(path.resolve().as_uri())
        else:
            print(f"  (missing) {path}")


def question(spark, args) -> None:
    append_audit(spark, _part(args, "audit"), args.question, args.k, args.subsystem)
    answer = ask(_retriever(spark, args), args.question, args.k, args.subsystem, local_chat())
    _show(answer, args.sources)
    if args.csv and answer.table is not None:
        write_csv(table_view(answer.table.orderBy("nth")), args.csv)
    if args.open:
        open_images(answer.images)


def chat_setting(line: str, state: dict) -> str | None:
    """Apply a ``:`` command to the chat state; the reply to print, None for a question."""
    words = line.split()
    if line == ":help":
        return CHAT_HELP
    if words[0] == ":k" and len(words) > 1:
        if not words[1].isdigit():
            return "  Usage: :k <integer>"
        state["k"] = int(words[1])
        return f"  sources per answer: {state['k']}"
    if words[0] == ":sources" and len(words) > 1:
        state["sources"] = words[1].lower() == "on"
        return f"  sources: {'on' if state['sources'] else 'off'}"
    if words[0] == ":sub" and len(words) > 1:
        state["subsystem"] = None if words[1].lower() == "off" else words[1].upper()
        return f"  subsystem: {state['subsystem'] or 'none'}"
    return None


def chat(spark, args) -> None:
    retriever = _retriever(spark, args)
    state = {"k": args.k, "sources": True, "subsystem": None}
    while True:
        try:
            line = input("You: ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if line == ":exit":
            return
        if not line:
            continue
        reply = chat_setting(line, state)
        if reply is not None:
            print(reply)
            continue
        try:
            answer = ask(retriever, line, state["k"], state["subsystem"], local_chat())
            _show(answer, state["sources"])
        except Exception as reason:
            print(f"  ERROR: {reason}")


def evaluation(spark, args) -> None:
    labelled = ev.cases_from_json(spark, args.cases) if args.cases else ev.cases(spark, LABELLED)
    frame = ev.evaluate(_retriever(spark, args), labelled, args.pool).persist()
    rows = [r.asDict() for r in frame.orderBy("ord").collect()]
    total = ev.totals(frame).first().asDict()
    print(ev.report_text(rows, total))
    if args.answers:
        rows = ev.answers(_retriever(spark, args), rows, local_chat())
    for path, text in ((args.json, ev.report_json), (args.html, ev.report_html)):
        if path:
            with open(path, "w", encoding="utf-8") as out:
                out.write(text(rows, total))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagewright")
    top.add_argument("--work", default="work", help="folder for tables")
    top.add_argument("--embedder", default="hashing", help="'hashing' or a sentence-transformers model name")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract"); p.add_argument("input"); p.add_argument("--registry", required=True)
    p.set_defaults(run=extract)
    p = sub.add_parser("caption"); p.add_argument("--limit", type=int); p.add_argument("--dry-run", action="store_true")
    p.set_defaults(run=caption)
    p = sub.add_parser("build"); p.add_argument("--reset", action="store_true"); p.set_defaults(run=build)
    p = sub.add_parser("ask"); p.add_argument("question"); p.add_argument("--k", type=int, default=rules.FINAL_K)
    p.add_argument("--subsystem", choices=rules.SUBSYSTEM_CHOICES); p.add_argument("--csv")
    p.add_argument("--open", action="store_true")
    p.add_argument("--no-sources", dest="sources", action="store_false"); p.set_defaults(run=question)
    p = sub.add_parser("chat"); p.add_argument("--k", type=int, default=rules.FINAL_K); p.set_defaults(run=chat)
    p = sub.add_parser("evaluate"); p.add_argument("--cases")
    p.add_argument("--pool", type=int, default=rules.EVAL_POOL); p.add_argument("--json"); p.add_argument("--html")
    p.add_argument("--answers", action="store_true"); p.set_defaults(run=evaluation)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(local_session(), args)


if __name__ == "__main__":
    main()
