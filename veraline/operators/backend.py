"""Running a caller's model against the request grid, and a caller's scorer or reward over answers.

The caller gives a factory: each worker makes its own model once, and asks it for bounded
batches.  Responses come back as rows under their request_id, in any order; a task that is run again
asks for the same requests with the same seeds.  What a backend can't answer is a row too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.operators.checks import ContractError, require_none, union
from veraline.operators.evaluation import RESPONSE, Protocol, generation_records, requests, response_violations
from veraline.plans.store import materialize

#: What a backend is told of a request.
REQUEST = ("request_id", "item_id", "item_index", "sample_index", "prompt", "seed")
_RESPONSE_FIELDS = [x.split()[0] for x in RESPONSE.split(", ")]
_RESPONSE_TYPES = pa.schema([("request_id", pa.string()), ("status", pa.string()), ("generated_text", pa.string()), ("output_token_ids", pa.list_(pa.int32())), ("finish_reason", pa.string()), ("error_code", pa.string())])
#: Requests that a backend is asked for at once.
BATCH = 32
_made: dict[str, Callable] = {}

Backend = Callable[[list[dict]], Iterable[dict]]


def _own(key: str, make: Callable[[], Callable]) -> Callable:
    """The worker's instance: made for the first batch, kept for later tasks; one at a time."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def failed(request_id: str, code: str) -> dict:
    return {"request_id": request_id, "status": "failed", "generated_text": None, "output_token_ids": None, "finish_reason": None, "error_code": code}


def _asked(backend: Backend, asked: list[dict]) -> list[dict]:
    """The backend's responses; where it raises, requests are asked one by one, and those that raise again are failed."""
    try:
        found = list(backend(asked))
    except Exception:
        if len(asked) == 1:
            return [failed(asked[0]["request_id"], "backend_error")]
        return [r for one in asked for r in _asked(backend, [one])]
    for r in found:
        if not isinstance(r, dict) or set(r) != set(_RESPONSE_FIELDS):
            raise ContractError("a backend returns responses with the fields of RESPONSE")
    return found


def respond(grid: DataFrame, make: Callable[[], Backend], batch: int = BATCH, partitions: int | None = None) -> DataFrame:
    """RESPONSE rows of a backend to all requests of the grid, as it keyed them: response_violations() judges them.

    make: called once in a worker; gives a function from up to `batch` dicts of REQUEST to dicts of RESPONSE.  Requests are dealt by
    their ids, so neither a long item nor its samples gather in one task.
    """
    if batch < 1:
        raise ContractError("a batch has a request or more")
    key = uuid.uuid4().hex
    dealt = grid.select(*REQUEST)
    dealt = dealt.repartition(partitions, "request_id") if partitions else dealt.repartition("request_id")

    def run(batches):
        for found in batches:
            rows = found.to_pylist()
            for a in range(0, len(rows), batch):
                yield pa.RecordBatch.from_pylist(_asked(_own(key, make), rows[a : a + batch]), schema=_RESPONSE_TYPES)

    return dealt.mapInArrow(run, RESPONSE)


def unanswered(grid: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a completed response: what a later run has to ask for."""
    return grid.join(responses.where("status = 'completed'").select("request_id").distinct(), "request_id", "left_anti")


def run_generation(items: DataFrame, protocol: Protocol, checkpoint_sha256: str, make: Callable[[], Backend], earlier: DataFrame | None = None, batch: int = BATCH, partitions: int | None = None) -> DataFrame:
    """The generation records of the whole grid, once each request has just one response.

    earlier: responses that are there already; only unanswered requests are asked for.
    Responses are a table in the shared folder before they're judged, so no request is asked twice for one run.
    """
    grid = materialize(requests(items, protocol, checkpoint_sha256), "requests")
    asked = grid if earlier is None else unanswered(grid, earlier)
    responses = materialize(respond(asked, make, batch, partitions), "responses")
    if earlier is not None:
        kept = earlier.where("status = 'completed'").join(grid.select("request_id"), "request_id")
        responses = union(responses, kept.select(*responses.columns))
    require_none(response_violations(grid, responses))
    return generation_records(grid, responses)


VERDICT = "verification_status string, extraction_status string, parse_status string, answer_source string, marker_count int"


def scored_by(make: Callable[[], Callable[[list[str], list[str]], Iterable[tuple]]]) -> Callable[[Column, Column], Column]:
    """A scorer of a caller's own: a function of (references, answers) to tuples of VERDICT, made once in a worker, as a column of (reference, answer).

    'match' is right, 'reference_invalid' stops a report, any other verification_status is wrong.
    """
    key, names = uuid.uuid4().hex, [x.split()[0] for x in VERDICT.split(", ")]

    @F.pandas_udf(T._parse_datatype_string(VERDICT))
    def score(reference: pd.Series, said: pd.Series) -> pd.DataFrame:
        told = list(_own(key, make)(reference.tolist(), said.tolist()))
        if len(told) != len(reference):
            raise ContractError("a scorer gives one verdict an answer")
        return pd.DataFrame(told, columns=names)

    return score


def rewarded(rows: DataFrame, make: Callable[[], Callable[[list[dict]], Iterable[float | None]]], inputs: list[str], batch: int = 1024) -> DataFrame:
    """rows with `reward`, 1 or 0, or null where the caller's function assigns none; any other value raises.

    make: called once in a worker; gives a function from up to `batch` dicts of the input columns to rewards.
    """
    if "reward" in {c.lower() for c in rows.columns}:
        raise ContractError("rows have a reward already")
    key, columns = uuid.uuid4().hex, rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("reward", T.DoubleType())])

    def run(batches):
        for found in batches:
            for a in range(0, found.num_rows, batch):
                part = found.slice(a, batch)
                values = list(_own(key, make)(part.select(inputs).to_pylist()))
                if len(values) != part.num_rows or any(v is not None and (isinstance(v, bool) or v not in (0, 1)) for v in values):
                    raise ContractError("a reward is 1, 0 or none, one a row")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if v is None else float(v) for v in values], pa.float64())], names=[*columns, "reward"])

    return rows.mapInArrow(run, schema)
