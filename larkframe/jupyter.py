"""A notebook kernel for SQL cells; `execute_cell` is the part that needs no notebook packages."""

from __future__ import annotations

from larkframe import formats
from larkframe.api import Engine
from larkframe.errors import EngineError, mapped

try:
    from ipykernel.kernelbase import Kernel
except ImportError:  # an optional package
    Kernel = None

MIME = "text/x-sql"


def execute_cell(engine: Engine, code: str, silent: bool = False) -> tuple[dict, dict | None, str | None]:
    """(reply, display bundle, error text) of a cell; silent and empty cells do nothing."""
    ok = {"status": "ok", "execution_count": 0, "payload": [], "user_expressions": {}}
    if silent or not code.strip():
        return ok, None, None
    try:
        return ok, formats.mimebundle(engine.sql(code)), None
    except Exception as e:
        own: EngineError = mapped(e)
        return {"status": "error", "ename": type(own).__name__, "evalue": str(own), "traceback": []}, None, str(own)


if Kernel is not None:

    class SqlKernel(Kernel):
        implementation = "larkframe"
        implementation_version = "1.0"
        language = "sql"
        language_info = {"name": "sql", "mimetype": MIME, "file_extension": ".sql"}
        banner = "SQL over Parquet files, run by Spark"
        _engine = None

        def do_execute(self, code, silent, store_history=True, user_expressions=None, allow_stdin=False, **_):
            if self._engine is None and not silent and code.strip():
                self._engine = Engine()
            reply, bundle, error = execute_cell(self._engine, code, silent)
            if bundle:
                self.send_response(self.iopub_socket, "display_data", {"data": bundle, "metadata": {}})
            if error:
                self.send_response(self.iopub_socket, "stream", {"name": "stderr", "text": error})
            return reply | {"execution_count": self.execution_count}
