import json
import random
from typing import List, Optional

import pytest
from pydantic import BaseModel, ValidationError, create_model, field_validator

from joblume.operators.replies import explode_records, has_records, parse_json, parse_replies, quarantine
from joblume.plans.specs import HARDWARE, JOBS


# An independent check: models with the same fields, judged by Pydantic.

class _Listed(BaseModel):
    @field_validator("requisitos", mode="before", check_fields=False)
    @classmethod
    def as_list(cls, value):
        return [] if value is None else [value] if isinstance(value, str) else value


class _Priced(BaseModel):
    @field_validator("preco_parcelado", mode="before", check_fields=False)
    @classmethod
    def zero(cls, value):
        return 0.0 if value is None else value


def model(spec, base):
    kinds = {"text": str, "texts": List[str], "number": float, "flag": bool}
    fields = {}
    for f in spec.fields:
        kind = Optional[kinds[f.kind]] if f.null_default else kinds[f.kind]
        fields[f.name] = (kind, ... if f.default is None else f.default)
    record = create_model("Record", __base__=base, **fields)
    return create_model("Reply", **{spec.list_field: (List[record], ... if spec.list_required else [])})


MODELS = {"jobs": model(JOBS, _Listed), "hardware": model(HARDWARE, _Priced)}


def judged(spec, response):
    try:
        reply = MODELS[spec.niche].model_validate_json(response)
    except ValidationError:
        return None
    return [[getattr(r, f.name) for f in spec.fields] for r in getattr(reply, spec.list_field)]


def parsed(spark, spec, responses, **options):
    frame = spark.createDataFrame(list(enumerate(responses)), "batch_id int, response string")
    rows = parse_replies(frame, spec, **options).orderBy("batch_id").collect()
    return [None if r.records is None else [list(x) for x in r.records] for r in rows], [r.reason for r in rows]


JOB = {"titulo": "Dev", "empresa": "Acme", "localizacao": "Remoto", "origem": "", "salario": "1", "requisitos": ["a"],
       "link_inscricao": "http://x"}
PRICE = {"produto": "GPU", "marca": "M", "preco_vista": 10.5, "preco_parcelado": 12, "loja": "L", "em_estoque": True}
VALUES = [None, 1, 0, 2, 1.0, 1.5, 0.0, True, False, "", "x", "10.5", " 7 ", "1_000", "1__0", "1d", "0x1p3", "R$ 1", "nan", "Infinity",
          "yes", "ON", "off", " true", "T", [], ["a", "b"], ["a", None], ["a", 1], [["a"]], {}, {"a": 1}, "é\n\"q\"",
          123456789012345678901234567890, 1e300, -5]


@pytest.mark.parametrize("spec, good", [(JOBS, JOB), (HARDWARE, PRICE)])
def test_random_replies_as_pydantic_judges_them(spark, spec, good):
    rng = random.Random(7)
    responses = []
    for _ in range(1500):
        records = []
        for _ in range(rng.randint(0, 3)):
            record = dict(good)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                name = rng.choice([*good, "extra"])
                if rng.random() < 0.2:
                    record.pop(name, None)
                else:
                    record[name] = rng.choice(VALUES)
            records.append(record if rng.random() > 0.03 else rng.choice(VALUES))
        reply = {spec.list_field: records if rng.random() > 0.05 else rng.choice(VALUES)}
        responses.append(json.dumps(reply if rng.random() > 0.05 else rng.choice([*VALUES, records]), ensure_ascii=rng.random() < 0.5))
    got, _ = parsed(spark, spec, responses)
    for response, ours in zip(responses, got):
        assert repr(ours) == repr(judged(spec, response)), response


@pytest.mark.parametrize("response", [
    '{"vagas": []}', ' \n{"vagas": []}\t', '{"vagas": []} x', '{"vagas": []}, {"vagas": []}', '{"vagas": []}]', '{"vagas": []},',
    '{"vagas": []}{"vagas": []}', '{"vagas": [],}', "{'vagas': []}", '{vagas: []}', '[{"vagas": []}]', '{"vagas": null}', '{}', '',
    'null', '{"vagas": [', '{"vagas": {}}', '{"Vagas": []}', '{"vagas": [null]}', '{"vagas": ["x"]}', '{"vagas": [{}]}', '{"vagas": []}]]',
    '{"vagas": [1], "vagas": []}', '{"vagas": [], "vagas": [1]}', '{"vagas": []}],[', '{"other": 01, "vagas": []}'])
def test_odd_replies(spark, response):
    assert parsed(spark, JOBS, [response])[0] == [judged(JOBS, response)]


def test_reasons_quarantine_and_guard(spark):
    bad = json.dumps({"vagas": [JOB, {**JOB, "titulo": None}]})
    responses = [json.dumps({"vagas": [JOB]}), bad, "oops", '{"x": 1}', None, '{"vagas": []}']
    frame = spark.createDataFrame(list(enumerate(responses)), "batch_id int, response string")
    result = parse_replies(frame)
    assert [r.reason for r in result.orderBy("batch_id").collect()] == \
        [None, "invalid record", "no JSON", "no list", "no reply", None]
    assert [(r.batch_id, r.response) for r in quarantine(result).orderBy("batch_id").collect()] == [(1, bad), (2, "oops"), (3, '{"x": 1}')]
    assert [r.batch_id for r in has_records(result).collect()] == [0]
    rows = explode_records(parse_replies(frame, per_record=True), ["batch_id"]).orderBy("batch_id").collect()
    assert [(r.batch_id, r.pos, r.titulo) for r in rows] == [(0, 0, "Dev"), (1, 0, "Dev")]


def test_whole_reply_is_one_value(apply):
    got = apply(['{"a": 1}', '{"a": 1} x', '1', '1, 0', '1], [0'], lambda c: parse_json(c).isNotNull())
    assert got == [True, False, True, False, False]
