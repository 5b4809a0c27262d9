"""Text expressions and the recursive text splitter."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.scalar import col, fixed2
from cohortry.schemas import CHUNK_OVERLAP, CHUNK_SIZE, TEXT_SEPARATORS

TEXTS_AT_ONCE = 64  # split in one go by the recursive splitter

# ---------------------------------------------------------------------------
# Texts that appear in results as they are.
# ---------------------------------------------------------------------------
SEARCH_PREFIX = "epilepsy "
SEARCH_RESISTANCE = "treatment resistance"
SEARCH_SUFFIX = "treatment guidelines recommendations"
SOURCE_LABEL = "Fonte "
DEFAULT_QUESTION = "Qual o melhor tratamento para este paciente?"
PROMPT_DEFAULTS = {
    "seizure_type": "não especificado",
    "seizure_frequency": "não especificada",
    "genotype": "não disponível",
    "previous_treatments": "nenhum",
    "treatment_response": "não disponível",
}
PROMPT_TEMPLATE = """Você é um especialista em neurologia e epilepsia. 
Sua tarefa é fornecer recomendações de tratamento baseadas em evidências científicas.

Contexto relevante da literatura médica:
{context}

Informações do paciente:
- Tipo de epilepsia: {seizure_type}
- Frequência de crises: {seizure_frequency}
- Genótipo: {genotype}
- Tratamentos anteriores: {previous_treatments}
- Resposta aos tratamentos: {treatment_response}

Pergunta: {question}

Forneça uma recomendação detalhada que inclua:
1. Tratamento sugerido e dosagem
2. Justificativa baseada em evidências
3. Potenciais efeitos colaterais
4. Monitoramento recomendado
5. Alternativas terapêuticas

Importante: Base suas recomendações apenas nas evidências fornecidas no contexto.
Se não houver informação suficiente, indique isso claramente.

Resposta:"""
REPORT_HEAD = "\nRecomendação de Tratamento\n==========================\n\n"
REPORT_CONFIDENCE = "\n\nConfiança: "
REPORT_SOURCES = "%\n\nFontes Consultadas:\n-------------------\n"
REPORT_PMID = "\n   PMID: "
REPORT_EXCERPT = "\n   Excerto: "
UNKNOWN_SOURCE = "Desconhecida"
UNKNOWN_PMID = "N/A"
REPORT_EXCERPT_CHARS = 200
RESPONSE_EXCERPT_CHARS = 500
# ---------------------------------------------------------------------------


def search_text(seizure_type: str | Column, genes: str | Column | None, treatments: str | Column | None) -> Column:
    """Search words of a patient. A null column means: the patient has no such entry.

    An empty treatment list still counts as an entry.
    """
    parts = [F.concat(F.lit(SEARCH_PREFIX), col(seizure_type))]
    if genes is not None:
        parts.append(F.array_join(F.slice(col(genes), 1, 3), " "))
    if treatments is not None:
        parts.append(F.when(col(treatments).isNotNull(), F.lit(SEARCH_RESISTANCE)))
    return F.concat_ws(" ", *parts, F.lit(SEARCH_SUFFIX))


def context_text(contents: str | Column) -> Column:
    """'Fonte 1: ...' blocks, separated by a blank line, from an ordered array."""
    numbered = F.transform(
        col(contents),
        lambda text, i: F.concat(F.lit(SOURCE_LABEL), (i + 1).cast("string"), F.lit(": "), text),
    )
    return F.array_join(numbered, "\n\n")


def fill_template(values: dict[str, Column], template: str = PROMPT_TEMPLATE) -> Column:
    """Replace {name} by a column; null values take the stated default."""
    pieces = []
    for literal in re.split(r"(\{\w+\})", template):
        if literal.startswith("{") and literal.endswith("}"):
            name = literal[1:-1]
            pieces.append(F.coalesce(values[name].cast("string"), F.lit(PROMPT_DEFAULTS.get(name, ""))))
        elif literal:
            pieces.append(F.lit(literal))
    return F.concat(*pieces)


def joined_or_default(values: str | Column, default: str) -> Column:
    """Items joined by a comma; null or empty lists become the default."""
    text = F.array_join(col(values), ", ")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


def report_text(answer: str | Column, confidence: str | Column, sources: str | Column) -> Column:
    """Full report; ``sources`` is an array of (source, pmid, content)."""
    blocks = F.transform(
        col(sources),
        lambda s, i: F.concat(
            F.lit("\n"), (i + 1).cast("string"), F.lit(". "), F.coalesce(s["source"], F.lit(UNKNOWN_SOURCE)),
            F.lit(REPORT_PMID), F.coalesce(s["pmid"], F.lit(UNKNOWN_PMID)),
            F.lit(REPORT_EXCERPT), F.substring(s["content"], 1, REPORT_EXCERPT_CHARS), F.lit("...\n"),
        ),
    )
    return F.concat(
        F.lit(REPORT_HEAD), col(answer), F.lit(REPORT_CONFIDENCE), fixed2(col(confidence) * 100),
        F.lit(REPORT_SOURCES), F.array_join(blocks, ""),
    )


def trimmed_sources(sources: str | Column) -> Column:
    """(id, content, metadata) per source, the content cut to the length of a response."""
    return F.transform(
        col(sources),
        lambda s: F.struct(
            s["id"].alias("id"),
            F.substring(s["content"], 1, RESPONSE_EXCERPT_CHARS).alias("content"),
            s["metadata"].alias("metadata"),
        ),
    )


def window_chunks(text: str | Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Fixed windows: every ``size - overlap`` characters until the text is covered.

    The text is cut into steps in one pass; a window is a step and the head of
    the next one. (A substring per window would walk the text from its start
    each time.)
    """
    t, step = col(text), size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must be between 0 and half of size")
    length = F.length(t)
    windows = F.when(length > size, F.ceil((length - size) / F.lit(float(step))) + 1).otherwise(1).cast("int")
    steps = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    following = F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1)))
    joined = F.zip_with(steps, following, lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, overlap), F.lit(""))))
    return F.slice(joined, 1, windows)


def split_text(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = tuple(TEXT_SEPARATORS),
) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that fits."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[level + 1 :]
    chunks: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        chunks.extend(_pack(small, size, overlap))
        small = []
        chunks.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    chunks.extend(_pack(small, size, overlap))
    return chunks


def _pieces(text: str, separator: str) -> Iterator[str]:
    """Cut before every separator, so that it opens the following piece."""
    if separator == "":
        yield from text
        return
    start = 0
    at = text.find(separator)
    while at != -1:
        if at > start:
            yield text[start:at]
        start, at = at, text.find(separator, at + len(separator))
    if start < len(text):
        yield text[start:]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces greedily; each chunk starts with the tail of the one before."""
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            chunk = "".join(held).strip()
            if chunk:
                yield chunk
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    chunk = "".join(held).strip()
    if chunk:
        yield chunk


def recursive_chunks(text: str | Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunks; the only Python function in the package's row-wise paths."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunked(texts: pa.Array) -> pa.Array:
        # a few texts at a time as Python strings; the rest of a batch stays as Arrow has it
        lists = pa.list_(pa.string())
        found = [pa.array([split_text(t, size, overlap) if t else [] for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()], lists)
                 for at in range(0, len(texts), TEXTS_AT_ONCE)]
        return pa.concat_arrays(found) if found else pa.array([], lists)

    return chunked(col(text))
