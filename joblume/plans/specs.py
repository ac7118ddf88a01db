"""Record schemas.  A niche is one ``SchemaSpec``; the plans take it as a value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    """One field of a record.

    ``kind`` is text, texts, number or flag.  A field without ``default`` must
    be there; ``null_default`` lets a JSON null stand for the default as well.
    """
    name: str
    kind: str
    default: object = None
    null_default: bool = False


@dataclass(frozen=True)
class SchemaSpec:
    niche: str
    list_field: str
    list_required: bool
    fields: tuple[Field, ...]
    name_field: str
    company_field: str | None
    required: tuple[str, ...]
    key: tuple[str, ...]

    @property
    def record_type(self) -> str:
        types = {"text": "string", "texts": "array<string>", "number": "double", "flag": "boolean"}
        return "struct<" + ", ".join(f"{f.name}: {types[f.kind]}" for f in self.fields) + ">"


# The fields of a job advert and of a hardware price -------------
JOBS = SchemaSpec(
    niche="jobs", list_field="vagas", list_required=True,
    fields=(Field("titulo", "text"), Field("empresa", "text"), Field("localizacao", "text"),
            Field("origem", "text"), Field("salario", "text"), Field("requisitos", "texts"),
            Field("link_inscricao", "text")),
    name_field="titulo", company_field="empresa",
    required=("titulo", "empresa"), key=("titulo", "empresa"))

HARDWARE = SchemaSpec(
    niche="hardware", list_field="produtos", list_required=False,
    fields=(Field("produto", "text", "Não informado"), Field("marca", "text", "Desconhecida"),
            Field("preco_vista", "number", 0.0), Field("preco_parcelado", "number", 0.0, null_default=True),
            Field("loja", "text", "Loja não identificada"), Field("em_estoque", "flag", False)),
    name_field="produto", company_field=None,
    required=("produto",), key=("produto", "marca", "loja"))
# ------------------------------------------------------------------------------
