"""A paginated registry API as a Spark data source: filters go to the server, pages are chained by tokens.

A token is known only from the page before, so one chain of pages is one task. The option `slices` (`status`, `phase` or both, by commas) cuts a pull into chains
that are disjoint and together the whole: a study has one status, and counts for the first of the asked phases that it has. With the option `pages`, a folder that all
executors share, each page is kept there before its rows are given, whole or not at all, so a task that is run again goes on behind the last kept page, and a whole
chain is not asked for again. Kept pages belong to one pull: a new pull takes a new folder. An answer that fails, or a token that has run out, raises. `delay` holds along a chain.
`client` is anything importable as `module:function` taking (url, params, timeout) and returning the decoded answer."""

import hashlib
import importlib
import json
import time
import urllib.parse
import urllib.request
import uuid

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

URL = "https://clinicaltrials.gov/api/v2/studies"
MOST_A_PAGE = 1000
#: Values the API knows (fixed values).
STATUSES = ["ACTIVE_NOT_RECRUITING", "COMPLETED", "ENROLLING_BY_INVITATION", "NOT_YET_RECRUITING", "RECRUITING", "SUSPENDED", "TERMINATED", "WITHDRAWN", "AVAILABLE", "NO_LONGER_AVAILABLE", "TEMPORARILY_NOT_AVAILABLE", "APPROVED_FOR_MARKETING", "WITHHELD", "UNKNOWN"]
PHASES = ["EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE3", "PHASE4", "NA"]


def urlopen_json(url: str, params: dict, timeout: float) -> dict:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as r:  # HTTP errors raise
        return json.load(r)


def parameters(statuses: list[str] = (), phases: list[str] = (), queries: dict[str, str] | None = None, advanced: str | None = None, page_size: int = MOST_A_PAGE) -> dict[str, str]:
    """The first request's parameters."""
    if bad := [s for s in statuses if s not in STATUSES]:
        raise ValueError(f"unknown statuses {bad}")
    if bad := [p for p in phases if p not in PHASES]:
        raise ValueError(f"unknown phases {bad}")
    out = {"format": "json", "pageSize": str(min(page_size, MOST_A_PAGE))}
    if statuses:
        out["filter.overallStatus"] = "|".join(statuses)
    by_phase = "(" + " OR ".join(f"AREA[Phase]{p}" for p in phases) + ")" if phases else None
    if expr := " AND ".join(x for x in (by_phase, f"({advanced})" if advanced and by_phase else advanced) if x):
        out["filter.advanced"] = expr
    return out | {f"query.{k}": v for k, v in (queries or {}).items() if v}


class Pages:
    """The pages of one chain, kept as files by number; without a folder nothing is kept."""

    def __init__(self, folder: str | None, url: str, params: dict):
        self.fs = None
        if folder:
            self.fs, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            self.at = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps([url, params], sort_keys=True).encode()).hexdigest()[:24]}"
            self.fs.create_dir(self.at, recursive=True)

    def get(self, n: int) -> dict | None:
        if self.fs is None or self.fs.get_file_info(f"{self.at}/{n}.json").type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(f"{self.at}/{n}.json") as f:
            return json.loads(f.read())

    def keep(self, n: int, page: dict) -> dict:
        """The page as it is kept: another attempt of the task may have been first."""
        if self.fs is None:
            return page
        part = f"{self.at}/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(page).encode())
        if (first := self.get(n)) is not None:
            self.fs.delete_file(part)
            return first
        self.fs.move(part, f"{self.at}/{n}.json")
        return page


def pull(client, params: dict, url: str = URL, most: int | None = None, delay: float = 1.2, timeout: float = 60.0, sleep=time.sleep, folder: str | None = None):
    """Records page by page, until a page is empty or the last, or `most` have come. Pages kept in `folder` are not asked for again."""
    pages, got, n, token, asked = Pages(folder, url, params), 0, 0, None, False
    while True:
        page = pages.get(n)
        if page is None:
            if asked:
                sleep(delay)
            page, asked = pages.keep(n, client(url, params | ({"pageToken": token} if n else {"countTotal": "true"}), timeout)), True
        studies, token, n = page.get("studies") or [], page.get("nextPageToken"), n + 1
        for s in studies:
            if most is not None and got >= most:
                return
            got += 1
            yield s
        if not studies or not token or (most is not None and got >= most):
            return


def chains(statuses: list[str], phases: list[str], advanced: str | None, slices: list[str]) -> list[tuple[list[str], list[str], str | None]]:
    """(statuses, phases, advanced) of each chain of pages: disjoint, together the whole."""
    if bad := set(slices) - {"status", "phase"}:
        raise ValueError(f"unknown slices {sorted(bad)}")
    if missing := [s for s, asked in (("status", statuses), ("phase", phases)) if s in slices and not asked]:
        raise ValueError(f"slices by {missing} need the values to cut by")
    by_status = [[s] for s in dict.fromkeys(statuses)] if "status" in slices else [statuses]
    by_phase = [(phases, advanced)]
    if "phase" in slices:
        phases, by_phase = list(dict.fromkeys(phases)), []
        for i, p in enumerate(phases):
            others = "NOT (" + " OR ".join(f"AREA[Phase]{q}" for q in phases[:i]) + ")" if i else None
            by_phase.append(([p], " AND ".join(x for x in (f"({advanced})" if advanced and others else advanced, others) if x) or None))
    return [(s, p, a) for s in by_status for p, a in by_phase]


class Chain(InputPartition):
    """One chain of pages, by the first request's parameters; None is the point lookup."""

    def __init__(self, params: dict | None):
        super().__init__(None)
        self.params = params


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        o = self.options
        if o.get("nctid"):
            return [Chain(None)]
        split = lambda k: [x.strip() for x in o.get(k, "").split(",") if x.strip()]
        if o.get("maxstudies") and split("slices"):
            raise ValueError("maxstudies counts along one chain: limit the table instead, or leave slices out")
        queries = {k[6:]: v for k, v in o.items() if k.startswith("query.")}
        return [Chain(parameters(s, p, queries, a, int(o.get("pagesize", MOST_A_PAGE)))) for s, p, a in chains(split("statuses"), split("phases"), o.get("advanced"), split("slices"))]

    def read(self, partition):
        o = self.options
        module, _, name = o.get("client", "cohortline.sources.rest:urlopen_json").partition(":")
        client = getattr(importlib.import_module(module), name)
        url, timeout = o.get("url", URL), float(o.get("timeout", 60))
        if partition.params is None:
            yield (json.dumps(client(f"{url}/{o['nctid']}", {"format": "json"}, float(o.get("timeout", 30)))),)
            return
        for s in pull(client, partition.params, url, int(o["maxstudies"]) if o.get("maxstudies") else None, float(o.get("delay", 1.2)), timeout, folder=o.get("pages")):
            yield (json.dumps(s),)


class RegistryApi(DataSource):
    """spark.dataSource.register(RegistryApi); spark.read.format("registry_api").option("statuses", "COMPLETED").load() -> one JSON record a row."""

    @classmethod
    def name(cls) -> str:
        return "registry_api"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
