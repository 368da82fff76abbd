"""First-come matching of requests to slots inside (doctor, day) groups.

Requests of a group are taken in batch order; one is accepted if neither its slot
nor its patient was matched before in the group. That sequential rule is computed in
rounds over all groups at once:

* A request that is the first one left for its slot and the first one left for its patient
  is accepted: nothing that comes before it can take either of them.
* All other requests for the slots and of the patients accepted so far are dropped; they
  come after the accepted one, or they would have been first.
* The rest goes into the next round. The earliest request of a group is always accepted,
  so there are no more rounds than slots are asked for in a group, and in practice a few.

A round is two minima, partial before the shuffle, and two anti-joins whose hot keys AQE
splits. No group is brought together anywhere, and a popular slot goes after one round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.requests import turn
from wardline.session import stage


def match_first_come(
    requests: DataFrame,
    group: Sequence[str] = ("doctor_id", "appointment_date"),
    place: str = "slot_id",
    person: str = "patient_id",
    keep: Callable[[DataFrame], DataFrame] = stage,
) -> DataFrame:
    """The accepted requests: ``group``, ``place``, ``person`` and ``turn``, at most one per place and per person.

    ``requests`` holds request_id, requested_at and these columns, none of them NULL. Each round
    is written by ``keep``, as the next one reads it several times.
    """
    by_place, by_person = [*group, place], [*group, person]
    # Only the first of equal requests can be accepted.
    left = keep(requests.groupBy(*group, place, person).agg(F.min(turn()).alias("turn")))
    rounds = []
    while True:
        # min of (turn, person): one row per place that is still asked for
        first = left.groupBy(*by_place).agg(F.min(F.struct("turn", person)).alias("first"))
        first = first.select(*by_place, "first.turn", f"first.{person}")
        own = left.groupBy(*by_person).agg(F.min("turn").alias("own"))
        accepted = keep(first.join(own, by_person).filter("turn = own").select(*group, place, person, "turn"))
        rounds.append(accepted)
        left = left.join(accepted.select(*by_place), by_place, "left_anti").join(accepted.select(*by_person), by_person, "left_anti")
        left = keep(left)
        if left.isEmpty():
            return reduce(DataFrame.unionAll, rounds)
