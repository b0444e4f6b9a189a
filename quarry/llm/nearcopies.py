"""Near copies of a corpus: SimHash fingerprints through the covering masks of simhash, then the exact join of jaccard for what fingerprints can't reach.

Two texts are near copies if the Jaccard similarity of their sets of five-word runs is 0.8 or more; a class is all that such links join. Pairs of fingerprints within the radius of the covering family are
candidates, and each is confirmed with the whole sets: they join most copies at once. At 0.8, though, fingerprints differ in about 10 of 64 bits, for which a covering family has 2^11 - 1 masks. So the
pairs that are left come from the join in a metric space, which misses none: what is found doesn't hang on a limit or on chance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, simhash

SHINGLE_WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
# The root of texts without words, which are one class.
WORDLESS = -1


class Copies(jaccard.Join):
    def _stars(self, members: DataFrame) -> DataFrame:
        """Candidates of the first round: those of the covering masks beside those of the neighbourhoods."""
        prints = self._few(self.nodes.groupBy("fp").agg(F.min("node").alias("first")))
        equal = self.nodes.select("node", "fp").join(prints.hint("merge"), "fp").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        near = simhash.links(prints.select(F.col("first").alias("node"), "fp"))
        return self._few(super()._stars(members).unionByName(equal).unionByName(near)).distinct()


def classes(rows: DataFrame, pairwise_limit: int = jaccard.DIRECT) -> DataFrame:
    """rows: row (anything that tells rows apart), text. (row, root): rows of one class have one root. Texts without words are one class. pairwise_limit decides
    the way, not the result: smaller regions are compared directly."""
    found = Copies(rows.select("row", "text"), SHINGLE_WORDS, NUMERATOR, DENOMINATOR, pairwise_limit, prints=True).classes()
    return found.select("row", F.coalesce("root", F.lit(WORDLESS)).alias("root"))
