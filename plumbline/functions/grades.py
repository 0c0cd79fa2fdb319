"""Grades, risks, levels and recommendations from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.paths import any_of, col


def steps(x: Column, limits: list[tuple[float, str]], last: str, inclusive: bool = True) -> Column:
    out = None
    for limit, name in limits:
        test = x <= limit if inclusive else x < limit
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def at_least(x: Column, limits: list[tuple[float, str]], last: str, strict: bool = False) -> Column:
    out = None
    for limit, name in limits:
        test = x > limit if strict else x >= limit
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def complexity_grade(cyclo, cog, mi, nesting) -> Column:
    """By 0.25 cyclomatic, 0.30 cognitive, 0.25 (100 - mi) and 0.40 nesting; hundredths are exact where counts are whole."""
    score = (25 * col(cyclo) + 30 * col(cog)) / 100 + 0.25 * (100 - col(mi)) + 40 * col(nesting) / 100
    return steps(score, [(10, "A"), (20, "B"), (35, "C"), (50, "D")], "F", inclusive=False)


def risk_level(cyclo, cog, cbo, mi) -> Column:
    return steps(col(cyclo) + col(cog) + 2 * col(cbo) + (100 - col(mi)), [(20, "low"), (50, "medium"), (100, "high")], "critical", inclusive=False)


def base_grade(c) -> Column:
    return steps(col(c), [(5, "A"), (10, "B"), (20, "C"), (35, "D")], "F")


def base_risk(c) -> Column:
    return steps(col(c), [(10, "low"), (25, "medium"), (50, "high")], "critical")


def complexity_level(c) -> Column:
    return steps(col(c), [(5, "low"), (15, "medium")], "high")


def complexity_bucket(c) -> Column:
    return steps(col(c), [(10, "low"), (25, "medium")], "high")


def refactoring_priority(weight, betweenness, cbo) -> Column:
    return F.least(F.lit(100.0), 0.4 * col(weight) + 15 * col(betweenness) + 0.3 * col(cbo))


def cluster_grade(cohesion, coupling, modularity, silhouette) -> Column:
    return at_least(30 * col(cohesion) + 30 * (1 - col(coupling)) + 20 * col(modularity) + 20 * col(silhouette), [(80, "A"), (65, "B"), (50, "C"), (35, "D")], "F", strict=True)


def cluster_quality(avg_complexity, size, connections) -> Column:
    a, n, c = col(avg_complexity), col(size), col(connections)
    less = F.when(a > 30, 30).when(a > 20, 15).when(a > 10, 5).otherwise(0) + F.when(n > 15, 20).when(n > 10, 10).otherwise(0) + F.when(c > 2 * n, 20).when(c > n, 10).otherwise(0)
    return at_least(100 - less, [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F")


def advice(rules: list[tuple[Column, str]]) -> Column:
    """Texts of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in rules]), lambda x: x.isNotNull())


def cluster_recommendations(cohesion, coupling, modularity, conductance, size) -> Column:
    return advice([
        (col(cohesion) < 0.3, "Low cohesion detected - consider splitting this cluster"),
        (col(coupling) > 0.7, "High coupling detected - review external dependencies"),
        (col(modularity) < 0.2, "Poor modularity - consider reorganizing cluster boundaries"),
        (col(conductance) > 0.8, "High conductance - cluster may be poorly separated"),
        (col(size) > 15, "Large cluster - consider sub-clustering for better maintainability"),
        (col(size) < 3, "Small cluster - consider merging with related clusters"),
    ])


def project_recommendations(modularity, average, density) -> Column:
    return advice([
        (col(modularity) < 0.3, "🏗️ Architecture: Poor modularity detected. Consider restructuring into more cohesive modules."),
        (col(average) > 30, "⚡ Complexity: High average complexity. Prioritize refactoring the most complex components."),
        (col(density) > 0.3, "🔗 Coupling: High network density indicates tight coupling. Consider introducing abstractions."),
    ])


def saved_recommendations(average, n_files, n_clusters) -> Column:
    return advice([
        (col(average) > 20, "Consider refactoring files with high complexity scores"),
        (col(n_files) > 100, "Large codebase - consider modularization strategies"),
        (col(n_clusters) < 3, "Code organization could benefit from better separation of concerns"),
    ])


def insights(modularity, average, density) -> Column:
    return advice([(col(modularity) > 0.6, "Good modularity score"), (col(average) > 20, "High average complexity"), (col(density) > 0.4, "High coupling detected")])


def saved_scores(average, n_files, n_clusters) -> dict[str, Column]:
    """Scores of a saved analysis."""
    a, n, k = col(average), col(n_files), col(n_clusters)
    return {
        "overall_score": half_up(0.5 * F.greatest(F.lit(0.0), 100 - 2 * a) + 0.2 * F.when(n > 100, 80).otherwise(100) + 0.3 * F.when(k > 0, 80).otherwise(40)),
        "complexity_grade": base_grade(a),
        "maintainability_score": clamp(100 - 2 * a),
        "security_risk": at_least(a, [(50, "critical"), (30, "high"), (15, "medium")], "low", strict=True),
        "technical_debt": half_up(a * n / 10),
    }


def ui_health(average) -> dict[str, Column]:
    a = col(average)
    return {"health": half_up(100 * (1 - a / 50)), "letter": steps(a, [(10, "A"), (20, "B"), (35, "C"), (50, "D")], "F"), "status": F.when(a > 15, "Needs attention").otherwise("Good"), "maintainability": steps(a, [(15, "Excellent"), (25, "Good")], "Needs Work")}


def http_status(message) -> Column:
    """Status for an error text."""
    m = col(message)
    has = lambda *parts: any_of([m.contains(x) for x in parts])
    return F.when(has("Unsupported archive format", "Cannot detect archive type"), 400).when(has("too large", "Too many"), 413).when(has("security", "dangerous"), 403).when(has("Path traversal", "Invalid"), 400).otherwise(500)
