"""Running programs under limits. Limits are no isolation: generated code belongs in a container as well, so this is opt-in."""

import resource
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CPU_SECONDS, WALL_SECONDS, ADDRESS_BYTES = 5, 5.0, 1 << 30


def _limits() -> None:
    resource.setrlimit(resource.RLIMIT_CPU, (CPU_SECONDS, CPU_SECONDS))
    resource.setrlimit(resource.RLIMIT_AS, (ADDRESS_BYTES, ADDRESS_BYTES))


def run_program(program: str, stdin: str | None, timeout: float = WALL_SECONDS) -> str | None:
    """Stripped standard output, or None for a time-out, a crash or another exit code than zero."""
    try:
        done = subprocess.run([sys.executable, "-c", program], input=stdin or "", capture_output=True, text=True, timeout=timeout, preexec_fn=_limits)
    except (subprocess.SubprocessError, OSError, ValueError):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def outputs(program: Column, unit_tests: Column, allow_execution: bool = False, timeout: float = WALL_SECONDS) -> Column:
    """array<string> of what a program prints for each test; after the first wrong answer the rest is null and not run."""
    if not allow_execution:
        raise PermissionError("running generated programs has to be allowed with allow_execution=True")

    @F.arrow_udf("array<string>")
    def run(programs: pa.Array, tests: pa.Array) -> pa.Array:
        out = []
        for p, ts in zip(programs.to_pylist(), tests.to_pylist(), strict=True):
            got, failed = [], p is None
            for t in ts or []:
                text = None if failed else run_program(p, t["input"], timeout)
                failed = failed or text is None or text not in [o.strip() for o in t["output"] or []]
                got.append(text)
            out.append(got)
        return pa.array(out, pa.list_(pa.string()))

    return run.asNondeterministic()(program, unit_tests)
