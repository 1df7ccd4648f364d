"""Whole-repository analysis over file, manifest and import facts, stage by stage on demand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from findlake.operators import graph, layers, modules, ownership, resolve
from findlake.session import materialize


@dataclass(frozen=True)
class Analysis:
    """Boundaries, graph, layers, cycles and ownership of the repositories in ``files``.

    ``files``: repo, path. ``manifests``: repo, dir, ecosystem, name, member. ``imports``: repo,
    file, line, specifier, scope. ``dependencies``: see ``modules.declared_edges``.
    ``owner_files``: repo, path, content. A stage runs when it is first asked for; what several
    stages read (modules, resolved imports, edges) is written once and read back.
    """

    files: DataFrame
    manifests: DataFrame
    imports: DataFrame
    dependencies: DataFrame
    owner_files: DataFrame
    aliases: DataFrame | None = None
    entries: DataFrame | None = None
    module_roots: Mapping[str, Sequence[str]] | None = None

    @cached_property
    def modules(self) -> DataFrame:
        return materialize(modules.infer_boundaries(self.files, self.manifests, self.module_roots), "modules")

    @cached_property
    def module_files(self) -> DataFrame:
        return materialize(modules.module_files(self.files, self.modules), "module-files")

    @cached_property
    def resolved(self) -> DataFrame:
        packages = self.modules.where("manifest = 'npm' AND name IS NOT NULL").select("repo", "name", "module")
        return materialize(resolve.resolve_scripts(self.imports, self.files, packages, self.aliases, self.entries), "resolved")

    @cached_property
    def edges(self) -> DataFrame:
        evidence = modules.import_edges(self.resolved, self.modules).unionByName(modules.declared_edges(self.dependencies, self.modules))
        return materialize(modules.edges(evidence), "edges")

    @property
    def unresolved(self) -> DataFrame:
        return modules.unresolved_imports(self.resolved)

    @property
    def layers(self) -> DataFrame:
        return layers.assign(self.modules)

    @property
    def violations(self) -> DataFrame:
        return layers.violations(self.edges, self.layers)

    @cached_property
    def cycles(self) -> DataFrame:
        return materialize(graph.cycles(self._links), "cycles")

    @property
    def shortest_cycles(self) -> DataFrame:
        return graph.shortest_cycles(self._links, self.cycles.select("repo", "component", "node"))

    @property
    def owners(self) -> DataFrame:
        rules = ownership.parse_rules(self.owner_files)
        return ownership.module_owners(self.module_files, ownership.owners_of(self.module_files, rules))

    @property
    def not_covered(self) -> DataFrame:
        """Files no module owns."""
        owned = self.module_files.select("repo", "path").distinct()
        return self.files.select("repo", "path").join(owned, ["repo", "path"], "left_anti")

    @property
    def _links(self) -> DataFrame:
        return self.edges.select("repo", "src", "dst").distinct()
