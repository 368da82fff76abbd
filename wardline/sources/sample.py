"""The hospital model over the sample star-schema tables.

Every hospital table is a projection of the sample files (customers become
patients, suppliers doctors, orders appointments and consultations, line items
ward visits, ...), so all of them grow with the scale factor. The request
frames feed the batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.sources.tables import Tables

AS_OF = "2001-08-01 00:00:00"
REPORT_DAY = "1999-03-15"
REPORT_RANGE = ("1999-01-01", "1999-03-31")

FILES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

class Sample:
    """Builds the hospital frames of one sample folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._raw = cache(self._read)
        self._rows = cache(lambda name: self._raw(name).agg(F.count(F.lit(1))).scalar())
        self.admissions = cache(self._admissions)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(FILES[name]).parquet(f"{self.folder}/{name}.parquet")

    def _doctor_of(self, key: str) -> Column:
        """Spread keys over the doctors; the row count is one scalar subquery."""
        return F.col(key) % self._rows("supplier")

    def _share(self, name: str, numerator: int, denominator: int = 1) -> Column:
        """A whole number in proportion to the rows of a file, at least 1."""
        return F.greatest(F.lit(1), F.floor(self._rows(name) * numerator / denominator)).cast("bigint")

    def _blocks(self) -> Column:
        """Ward blocks: one per ten doctors, each with eleven rooms and 81 beds."""
        return F.ceil(self._rows("supplier") / 10).cast("bigint")

    def _spread(self, rows: DataFrame) -> DataFrame:
        """A small file over all tasks, for what makes many rows of each of its rows.

        The file is one split; the number of tasks is given, so that it is not adapted to the few bytes.
        """
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def _events(self, **scales: Column) -> DataFrame:
        """The events with numbers that follow from the table sizes."""
        return self._raw("events").withColumns(scales)

    def _numbered(self, lines: DataFrame, name: str) -> DataFrame:
        """Give line items a key: the place in their order, then the order.

        The file has no key. The number of orders is the base of the place, so keys are
        distinct at every size; one too large for its type would raise an error.
        ``lines`` holds all lines of an order or none.
        """
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
        base = self._raw("orders").agg(F.max("o_orderkey") + 1).scalar()
        return lines.withColumn(name, place * base + F.col("l_orderkey"))

    def specializations(self) -> DataFrame:
        return self._raw("region").selectExpr(
            "cast(r_regionkey + 1 as int) specialization_id",
            "case r_regionkey when 0 then 'Cardiology' when 1 then 'Neurology' when 2 then 'Orthopedics'"
            " when 3 then 'Dermatology' else 'Pediatrics' end specialization_name",
        )

    def doctors(self) -> DataFrame:
        return self._raw("supplier").selectExpr(
            "s_suppkey doctor_id",
            "concat('D', s_suppkey) doctor_login_id",
            "split_part(s_name, '#', 1) first_name",
            "split_part(s_name, '#', 2) last_name",
            "cast(30 + s_suppkey % 40 as int) age",
            "cast(s_nationkey % 5 + 1 as int) specialization_id",
            "cast(500 + (s_suppkey % 20) * 50 as decimal(10,2)) consultation_fee",
            "concat('0300', s_suppkey) phone_no",
            "cast(s_suppkey % 40 as int) experience_years",
            "concat('REG-', s_suppkey) registration_number",
            "cast(s_suppkey + 1 as int) room_no",
        )

    def patients(self) -> DataFrame:
        return self._raw("customer").selectExpr(
            "c_custkey patient_id",
            "concat('P', c_custkey) patient_login_id",
            "split_part(c_name, '#', 1) first_name",
            "split_part(c_name, '#', 2) last_name",
            "cast((c_custkey * 7) % 100 as int) age",
            "case c_custkey % 3 when 0 then 'Male' when 1 then 'Female' else 'Other' end gender",
            "case c_custkey % 4 when 0 then 'A+' when 1 then 'B+' when 2 then 'AB-' else 'O-' end blood_group",
            "concat('0311', c_custkey) phone_no",
            "date_add(date'1995-01-01', cast((c_custkey * 13) % 2400 as int)) created_at",
        )

    def receptionists(self) -> DataFrame:
        return self._raw("nation").selectExpr(
            "n_nationkey + 5 receptionist_id",
            "concat('R', n_nationkey + 5) receptionist_login_id",
            "'Desk' first_name",
            "n_name last_name",
            "concat('0322', n_nationkey) contact_no",
        )

    def admin(self) -> DataFrame:
        first = self._raw("region").filter("r_regionkey = 0")
        return first.selectExpr("r_regionkey + 1 admin_id", "concat('A', r_regionkey + 1) admin_login_id", "'root' username")

    def time_slots(self) -> DataFrame:
        return self._raw("nation").filter("n_nationkey < 24").selectExpr(
            "n_nationkey + 1 slot_id",
            "n_nationkey + 1 slot_number",
            "360 + 30 * n_nationkey start_min",
            "390 + 30 * n_nationkey end_min",
        )

    def doctor_schedules(self) -> DataFrame:
        weekly = (
            self._spread(self._raw("supplier").select("s_suppkey"))
            .selectExpr("s_suppkey", "explode(sequence(0, 6)) day")
            .selectExpr("s_suppkey", "day", "explode(sequence(0, 23)) slot")
            .filter("(s_suppkey + day + slot) % 3 <> 0")
        )
        return weekly.selectExpr(
            "(s_suppkey * 7 + day) * 24 + slot schedule_id",
            "s_suppkey doctor_id",
            "day day_of_week",
            "slot + 1 slot_id",
            "(s_suppkey + slot) % 11 <> 0 is_active",
        )

    def appointment_statuses(self) -> DataFrame:
        return self._raw("nation").filter("n_nationkey < 3").selectExpr(
            "n_nationkey + 1 status_id",
            "case n_nationkey when 0 then 'Scheduled' when 1 then 'Completed' else 'Cancelled' end status_name",
        )

    def action_types(self) -> DataFrame:
        return self._raw("nation").filter("n_nationkey < 4").selectExpr(
            "n_nationkey + 1 action_type_id",
            "case n_nationkey when 0 then 'Admit' when 1 then 'X-Ray' when 2 then 'Blood Test'"
            " else 'Follow up checkup' end action_name",
        )

    def appointments(self) -> DataFrame:
        return self._raw("orders").withColumn("doctor", self._doctor_of("o_orderkey")).selectExpr(
            "o_orderkey appointment_id",
            "o_custkey patient_id",
            "doctor doctor_id",
            "cast(o_orderdate as date) appointment_date",
            "cast(o_orderkey % 24 + 1 as int) slot_id",
            "case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end status_id",
            "o_orderdate created_at",
        )

    def appointment_forms(self) -> DataFrame:
        return self._raw("orders").filter("o_orderkey % 2 = 0").selectExpr(
            "o_orderkey form_id",
            "o_orderkey appointment_id",
            "o_custkey patient_id",
            "o_orderpriority symptoms",
            "case when o_orderkey % 4 = 0 then null else 'none' end medical_history",
            "o_orderdate created_at",
        )

    def appointment_cancellations(self) -> DataFrame:
        return self._raw("orders").filter("o_orderstatus = 'P'").selectExpr(
            "o_orderkey cancellation_id",
            "o_orderkey appointment_id",
            "o_custkey patient_id",
            "o_orderpriority cancellation_reason",
            "o_orderdate cancelled_at",
        )

    def consultations(self) -> DataFrame:
        done = self._raw("orders").filter("o_orderstatus = 'F'").withColumn("doctor", self._doctor_of("o_orderkey"))
        return done.selectExpr(
            "o_orderkey consultation_id",
            "o_orderkey appointment_id",
            "doctor doctor_id",
            "o_custkey patient_id",
            "case when o_orderkey % 5 = 0 then null"
            " else concat(100 + o_orderkey % 40, '/', 60 + o_orderkey % 30) end blood_pressure",
            "case when o_orderkey % 6 = 0 then null"
            " else cast(96 + (o_orderkey % 80) * 0.1 as decimal(5,2)) end temperature",
            "case when o_orderkey % 8 = 0 then null else cast(85 + o_orderkey % 16 as int) end oxygen_saturation",
            "case when o_orderkey % 7 = 0 then null else o_orderpriority end diagnosis",
            "o_orderdate consultation_date",
        )

    def prescribed_medicines(self) -> DataFrame:
        ordered = (
            self._raw("lineitem")
            .join(self._raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
            .join(self.consultations().select(F.col("consultation_id").alias("l_orderkey")), "l_orderkey", "left_semi")
        )
        return self._numbered(ordered, "medicine_id").selectExpr(
            "medicine_id",
            "l_orderkey consultation_id",
            "p_name medicine_name",
            "concat(cast(l_quantity as int), 'mg') dosage",
            "p_type frequency",
            "concat(l_linenumber, ' days') duration",
            "l_shipdate created_at",
        )

    def consultation_actions(self) -> DataFrame:
        return self._raw("orders").filter("o_orderstatus = 'F' and o_orderkey % 2 = 0").selectExpr(
            "o_orderkey action_id",
            "o_orderkey consultation_id",
            "cast(o_orderkey % 4 + 1 as int) action_type_id",
            "case when o_orderkey % 12 = 0 then 'Pending' else 'Completed' end status",
            "o_orderpriority notes",
            "o_orderdate created_at",
        )

    def room_types(self) -> DataFrame:
        return self._raw("nation").filter("n_nationkey < 11").selectExpr(
            "n_nationkey + 1 room_type_id",
            "case n_nationkey when 0 then 'GWARD-CARD-M' when 1 then 'GWARD-CARD-F' when 2 then 'GWARD-ORTHO-M'"
            " when 3 then 'GWARD-ORTHO-F' when 4 then 'GWARD-NEURO-M' when 5 then 'GWARD-NEURO-F'"
            " when 6 then 'GWARD-DERMA-M' when 7 then 'GWARD-DERMA-F' when 8 then 'GWARD-PED-M'"
            " when 9 then 'GWARD-PED-F' else 'PRIVATE ROOM' end type_name",
            "cast(case when n_nationkey < 2 then 1500 when n_nationkey < 4 then 1400 when n_nationkey < 6 then 1600"
            " when n_nationkey < 8 then 1200 when n_nationkey < 10 then 1300 else 4000 end as decimal(10,2))"
            " per_day_charges",
        )

    def _admissions(self) -> DataFrame:
        admitted = (
            self._raw("orders")
            .filter("o_orderstatus = 'F' and o_orderkey % 4 = 0")
            .withColumn("doctor", self._doctor_of("o_orderkey"))
            .withColumn("place", F.col("o_orderkey") % (self._blocks() * 81))
        )
        return admitted.selectExpr(
            "o_orderkey admission_id",
            "o_custkey patient_id",
            "doctor doctor_id",
            "o_orderkey consultation_id",
            "o_orderkey action_id",
            "cast(place div 81 * 11 + place % 81 div 8 + 1 as int) initial_room_id",
            "cast(place + 1 as int) bed_id",
            "o_orderdate admission_date",
            "case when o_orderkey % 20 = 0 then null"
            " else o_orderdate + cast(3 + o_orderkey % 5 as int) * interval '1' day end discharge_date",
            "o_orderkey % 20 = 0 is_active",
            "o_orderpriority admission_notes",
            "5 + o_orderkey % 25 assigned_by_receptionist_id",
        )

    def beds(self) -> DataFrame:
        taken = (
            self.admissions()
            .filter("is_active and bed_id % 3 = 0")
            .select("bed_id")
            .distinct()
            .withColumn("taken", F.lit(True))
        )
        places = self._rooms().selectExpr(
            "room", "block", "explode(sequence(0, case when room < 10 then 7 else 0 end)) place"
        ).selectExpr(
            "cast(block * 81 + room * 8 + place + 1 as int) bed_id",
            "cast(block * 11 + room + 1 as int) room_id",
            "place + 1 bed_number",
            "concat('R', block * 11 + room + 1, '-B', place + 1) bed_code",
        )
        return places.join(taken, "bed_id", "left").selectExpr(
            "bed_id", "room_id", "bed_number", "bed_code", "taken is not null is_occupied"
        )

    def _rooms(self) -> DataFrame:
        """Every room with its block and its place in it; doctors are numbered without gaps."""
        blocks = self._raw("supplier").selectExpr("s_suppkey div 10 block").distinct()
        return blocks.selectExpr("block", "explode(sequence(0, 10)) room")

    def rooms(self) -> DataFrame:
        full = self.beds().groupBy("room_id").agg(F.bool_and("is_occupied").alias("is_occupied"))
        plain = self._rooms().selectExpr(
            "cast(block * 11 + room + 1 as int) room_id",
            "concat('ROOM-', block * 11 + room + 1) room_number",
            "room + 1 room_type_id",
            "room % 6 + 1 floor_number",
        )
        return plain.join(full, "room_id")

    def admitted_patient_visits(self) -> DataFrame:
        stays = self.admissions().select(F.col("admission_id"), "patient_id", "doctor_id")
        visits = self._raw("lineitem").join(stays, F.col("l_orderkey") == F.col("admission_id"))
        return self._numbered(visits, "visit_id").selectExpr(
            "visit_id",
            "admission_id",
            "patient_id",
            "doctor_id",
            "l_shipdate visit_datetime",
            "concat(100 + l_linenumber, '/', 70 + l_linenumber) blood_pressure",
            "cast(90 + l_quantity * 0.4 as double) temperature",
            "cast(round(100 - l_discount * 100) as int) oxygen_saturation",
            "cast(60 + l_quantity as int) pulse_rate",
            "case cast(l_quantity as int) % 4 when 0 then 'Stable' when 1 then 'Improving' when 2 then 'Critical'"
            " else 'Deteriorating' end condition_status",
            "l_returnflag = 'R' ready_for_discharge",
            "case when l_returnflag = 'R' then l_shipdate + interval '1' day end discharge_recommended_date",
        )

    def discharges(self) -> DataFrame:
        bills = self._raw("orders").selectExpr("o_orderkey admission_id", "o_totalprice", "o_orderpriority")
        closed = self.admissions().filter("not is_active").join(bills, "admission_id")
        return closed.selectExpr(
            "admission_id discharge_id",
            "admission_id",
            "patient_id",
            "doctor_id",
            "discharge_date",
            "cast(3 + admission_id % 5 as int) total_days",
            "cast(floor(o_totalprice * 0.5) as decimal(12,2)) room_charges",
            "cast(floor(o_totalprice * 0.25) as decimal(12,2)) medical_charges",
            "cast(0 as decimal(12,2)) doctor_visit_charges",
            "cast(0 as decimal(12,2)) lab_charges",
            "cast(0 as decimal(12,2)) other_charges",
            "cast(o_totalprice as decimal(12,2)) total_amount",
            "case admission_id % 3 when 0 then 'Unpaid' when 1 then 'Paid' else 'Partial' end payment_status",
            "cast(case admission_id % 3 when 0 then 0 when 1 then o_totalprice else 100 end as decimal(12,2))"
            " amount_paid",
            "o_orderpriority final_diagnosis",
            "admission_id % 8 = 0 follow_up_required",
            "assigned_by_receptionist_id processed_by_receptionist_id",
        )

    def removed_doctors(self) -> DataFrame:
        return self._raw("supplier").filter("s_suppkey % 10 = 9").selectExpr(
            "s_suppkey removed_doctor_id",
            "s_suppkey doctor_id",
            "s_name doctor_name",
            "cast(s_nationkey % 5 + 1 as int) specialization_id",
            "'left' removal_reason",
            "cast(s_suppkey % 10 - 8 as int) removed_by_admin_id",
            "date_add(date'2001-01-01', cast(s_suppkey % 200 as int)) removal_date",
        )

    def signin_logs(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id log_id",
            "concat('', user_id) user_id",
            "case event_type when 'error' then 'admin' when 'view' then 'doctor' when 'purchase' then 'receptionist'"
            " else 'patient' end user_type",
            "ts signin_datetime",
        )

    def signup_logs(self) -> DataFrame:
        return self.patients().selectExpr(
            "patient_id signup_log_id", "patient_id", "first_name", "last_name", "created_at signup_datetime"
        )

    # --- reference lists that grow with the sample ---------------------------

    def long_specializations(self) -> DataFrame:
        return self._raw("part").selectExpr("p_partkey + 1 specialization_id", "p_name specialization_name")

    def long_time_slots(self) -> DataFrame:
        return self._raw("part").selectExpr(
            "p_partkey + 1 slot_id",
            "cast(p_partkey + 1 as int) slot_number",
            "cast(p_partkey * 7 % 1410 as int) start_min",
            "cast(p_partkey * 7 % 1410 + 30 as int) end_min",
        )

    def long_action_types(self) -> DataFrame:
        return self._raw("part").selectExpr("p_partkey + 1 action_type_id", "p_type action_name")

    def long_receptionists(self) -> DataFrame:
        return self._raw("customer").selectExpr(
            "c_custkey + 5 receptionist_id",
            "concat('R', c_custkey + 5) receptionist_login_id",
            "c_mktsegment first_name",
            "c_name last_name",
            "concat('0322', c_custkey) contact_no",
        )

    def long_room_types(self) -> DataFrame:
        return self._raw("part").selectExpr(
            "p_partkey + 1 room_type_id",
            "concat(case p_size % 3 when 0 then 'GWARD-' when 1 then 'PRIVATE ' else 'DAY-' end, upper(p_type),"
            " case p_partkey % 3 when 0 then '-M' when 1 then '-F' else '' end) type_name",
            "cast(p_retailprice as decimal(10,2)) per_day_charges",
        )

    # --- request frames of the batch jobs ----------------------------------

    def booking_requests(self) -> DataFrame:
        return self._events(
            people=self._share("customer", 2, 15), staff=self._share("supplier", 3, 25)
        ).selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id % people patient_id",
            "user_id % staff doctor_id",
            "date_add(date'2001-08-01', cast(event_id % 11 - 1 as int)) appointment_date",
            "cast(event_id % 26 + 1 as int) slot_id",
        )

    def _open_places(self) -> Column:
        """Somewhat more numbers than there are open stays, which are every 20th order."""
        return self._share("orders", 4, 75)

    def visit_requests(self) -> DataFrame:
        asked = self._events(places=self._open_places()).withColumn("stay", F.expr("(event_id % places) * 20"))
        stays = self.admissions().selectExpr("admission_id stay", "patient_id", "doctor_id")
        return asked.join(stays, "stay", "left").selectExpr(
            "event_id request_id",
            "ts requested_at",
            "stay admission_id",
            "case when event_id % 7 = 0 then patient_id + 1 else patient_id end patient_id",
            "doctor_id",
            "concat(100 + event_id % 40, '/', 60 + event_id % 30) blood_pressure",
            "cast(88 + event_id % 23 as double) temperature",
            "cast(event_id % 103 as int) oxygen_saturation",
            "cast(event_id % 311 as int) pulse_rate",
            "case event_id % 6 when 0 then 'Stable' when 1 then 'Improving' when 2 then 'Critical'"
            " when 3 then 'Deteriorating' when 4 then 'Fair' end condition_status",
            "event_id % 3 = 0 ready_for_discharge",
            "case event_id % 5 when 0 then ts when 1 then timestamp_ntz '1990-01-01 00:00:00' end"
            " discharge_recommended_date",
        )

    def admit_requests(self) -> DataFrame:
        actions = self.consultation_actions().filter("action_type_id = 1")
        seen = self.consultations().select("consultation_id", "patient_id", "doctor_id")
        asked = actions.join(seen, "consultation_id").withColumn("blocks", self._blocks())
        return asked.selectExpr(
            "action_id request_id",
            "created_at requested_at",
            "case when action_id % 28 = 0 then null else patient_id end patient_id",
            "doctor_id",
            "consultation_id",
            "action_id",
            "cast(action_id % (blocks * 11) + 1 as int) initial_room_id",
            "cast(action_id % (blocks * 90) + 1 as int) bed_id",
            "notes admission_notes",
            "5 + action_id % 27 assigned_by_receptionist_id",
        )

    def discharge_requests(self) -> DataFrame:
        return self._events(
            places=self._open_places(),
            people=self._share("customer", 1, 15),
            staff=self._share("supplier", 3, 25),
            blocks=self._blocks(),
        ).selectExpr(
            "event_id request_id",
            "ts requested_at",
            "(event_id % places) * 20 + case when event_id % 9 = 0 then 4 else 0 end admission_id",
            "user_id % people + 1 patient_id",
            "user_id % staff doctor_id",
            "cast(event_id % (blocks * 81) + 1 as int) bed_id",
            "cast(round(value * 20000) as decimal(12,2)) total_bill",
            "cast(round(value * 10) as decimal(12,2)) final_bill_amount",
            "case when event_id % 5 <> 0 then cast(event_id % 1000 as decimal(12,2)) end room_charges",
            "cast(round(value) as decimal(12,2)) medical_charges",
            "cast(event_id % 40 - 1 as decimal(12,2)) lab_charges",
            "case when event_id % 4 = 0 then timestamp_ntz '2001-08-05 10:00:00' end discharge_date",
            "5 + event_id % 26 discharged_by_receptionist_id",
            "5 + event_id % 26 processed_by_receptionist_id",
        )

    def bed_requests(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id request_id", "ts requested_at", "user_id + 1 bed_id", "value < 20 is_occupied"
        )

    def schedule_patches(self) -> DataFrame:
        return self._events(rows=self._share("supplier", 40)).selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id % rows schedule_id",
            _map(
                day_of_week=("event_id % 2 = 0", "cast(event_id % 9 as string)"),
                slot_id=("event_id % 3 = 0", "cast(event_id % 25 + 1 as string)"),
                is_active=("event_id % 5 = 0", "case when event_id % 10 = 0 then 'true' else 'false' end"),
            ),
        )

    def action_patches(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id * 2 action_id",
            _map(
                status=(
                    "event_id % 2 = 0",
                    "case event_id % 8 when 0 then 'Completed' when 2 then 'Cancelled' when 4 then 'Pending'"
                    " else 'Open' end",
                ),
                notes=("event_id % 3 = 0", "case when event_id % 6 = 0 then props end"),
            ),
        )

    def visit_patches(self) -> DataFrame:
        """Patches of the ward visits of the same order number as the event."""
        visits = self.admitted_patient_visits().select("visit_id", "admission_id")
        return self._raw("events").join(visits, F.col("event_id") == F.col("admission_id")).selectExpr(
            "visit_id request_id",
            "ts requested_at",
            "visit_id",
            _map(
                temperature=("event_id % 3 = 0", "case when event_id % 9 = 0 then 'hot' else '98.60' end"),
                pulse_rate=("event_id % 5 = 0", "cast(200 + event_id % 150 as string)"),
                condition_status=("event_id % 7 = 0", "cast(null as string)"),
                ready_for_discharge=("event_id % 8 = 0", "case when event_id % 16 = 0 then 'true' end"),
            ),
        )

    def follow_up_patches(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id * 4 discharge_id",
            _map(
                follow_up_required=("event_id % 2 = 0", "case when event_id % 4 = 0 then 'true' end"),
                follow_up_date=("event_id % 3 = 0", "'2001-09-01'"),
                follow_up_notes=("event_id % 5 = 0", "props"),
            ),
        )

    def removal_requests(self) -> DataFrame:
        return self._events(staff=self._share("supplier", 13, 10)).selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id % staff doctor_id",
            "case when event_id % 11 = 0 then '' else event_type end removal_reason",
            "case when event_id % 13 = 0 then 2 else 1 end removed_by_admin_id",
        )

    def schedule_deletions(self) -> DataFrame:
        return self._events(rows=self._share("supplier", 60)).selectExpr(
            "event_id request_id", "ts requested_at", "event_id % rows schedule_id"
        )

    def slot_deletions(self) -> DataFrame:
        """Every second slot, many times over, and slots that are not there."""
        return self._raw("customer").selectExpr(
            "c_custkey request_id", "timestamp_ntz '2001-08-01 00:00:00' requested_at", "cast(c_custkey % 40 * 2 as bigint) slot_id"
        )

    def new_patients(self) -> DataFrame:
        return self._raw("customer").selectExpr(
            "c_custkey request_id",
            "timestamp_ntz '2001-08-01 00:00:00' requested_at",
            "case when c_custkey % 10 = 0 then '' else c_mktsegment end first_name",
            "c_name last_name",
            "cast(c_custkey % 160 as int) age",
            "case c_custkey % 4 when 0 then 'Male' when 1 then 'female' when 2 then 'Other' else 'None' end gender",
            "case when c_custkey % 2 = 0 then 'A+' else '' end blood_group",
        )

    def new_doctors(self) -> DataFrame:
        return self._raw("part").withColumn("numbers", self._share("supplier", 3)).selectExpr(
            "p_partkey request_id",
            "timestamp_ntz '2001-08-01 00:00:00' requested_at",
            "p_brand first_name",
            "p_type last_name",
            "p_size + 15 age",
            "cast(p_partkey % 7 as int) specialization_id",
            "cast(p_partkey % 3 * 100 as decimal(10,2)) consultation_fee",
            "cast(p_partkey % 9 as int) experience_years",
            "case when p_partkey % 6 <> 0 then concat('REG-', p_partkey % numbers) end registration_number",
        )

    def new_forms(self) -> DataFrame:
        return self._events(rows=self._share("orders", 2, 5)).selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id % rows appointment_id",
        ).join(
            self._raw("orders").selectExpr("o_orderkey appointment_id", "o_custkey", "o_orderpriority"),
            "appointment_id",
            "left",
        ).selectExpr(
            "request_id",
            "requested_at",
            "appointment_id",
            "case when request_id % 8 = 0 then o_custkey + 1 else o_custkey end patient_id",
            "o_orderpriority symptoms",
        )

    def new_consultations(self) -> DataFrame:
        asked = self._events(rows=self._share("orders", 7, 15)).selectExpr(
            "event_id request_id", "ts requested_at", "event_id % rows appointment_id"
        )
        people = self.appointments().select("appointment_id", "patient_id", "doctor_id")
        return asked.join(people, "appointment_id", "left").selectExpr(
            "request_id",
            "requested_at",
            "appointment_id",
            "case when request_id % 50 = 0 then 999999999 else doctor_id end doctor_id",
            "patient_id",
            "case when request_id % 4 = 0 then '' else '120/80' end blood_pressure",
            "case when request_id % 3 = 0 then cast(0 as double) else 98.5d end temperature",
        )

    def new_schedules(self) -> DataFrame:
        return self._events(staff=self._share("supplier", 11, 10)).selectExpr(
            "event_id request_id",
            "ts requested_at",
            "user_id % staff doctor_id",
            "case when event_id % 40 <> 0 then cast(event_id % 8 as int) end day_of_week",
            "cast(event_id % 26 as int) slot_id",
            "case when event_id % 3 = 0 then false end is_active",
        )

    def new_medicines(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id consultation_id",
            "event_type medicine_name",
            "case when event_id % 9 = 0 then '' else '5mg' end dosage",
            "case when event_id % 10 = 0 then repeat('x', 51) else 'daily' end frequency",
            "'3 days' duration",
        )

    def new_receptionists(self) -> DataFrame:
        return self._raw("customer").selectExpr(
            "c_custkey request_id",
            "timestamp_ntz '2001-08-01 00:00:00' requested_at",
            "c_mktsegment first_name",
            "case when c_custkey % 6 = 0 then null else c_name end last_name",
            "case when c_custkey % 4 = 0 then '' else concat('0322', c_custkey) end contact_no",
        )

    def new_actions(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id request_id",
            "ts requested_at",
            "event_id consultation_id",
            "event_id % 6 action_type_id",
            "props notes",
        )

    def new_signins(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id request_id", "ts requested_at", "concat('', user_id) user_id",
            "case when event_type <> 'error' then event_type end user_type",
        )

    def room_requests(self) -> DataFrame:
        return self._events(blocks=self._blocks()).selectExpr(
            "event_id request_id", "ts requested_at", "user_id % (blocks * 13) + 1 room_id", "value < 50 is_occupied"
        )

    def raw_visits(self) -> DataFrame:
        """Unchecked visit rows, with values outside the rules."""
        return self.admitted_patient_visits().selectExpr(
            "case when pulse_rate % 7 = 0 then admission_id else visit_id end visit_id",
            "case when pulse_rate % 10 = 0 then -1 else admission_id end admission_id",
            "patient_id",
            "case when pulse_rate % 9 = 0 then null else doctor_id end doctor_id",
            "visit_datetime",
            "temperature + 5 temperature",
            "oxygen_saturation",
            "pulse_rate * 4 pulse_rate",
            "case when pulse_rate % 8 = 0 then 'Fair' else condition_status end condition_status",
            "ready_for_discharge",
        )


def _map(**fields: tuple[str, str]) -> str:
    """A ``changes`` map that names a field only where its condition holds."""
    entries = ", ".join(
        f"case when {given} then struct('{name}' as key, {value} as value) end"
        for name, (given, value) in fields.items()
    )
    return f"map_from_entries(array_compact(array({entries}))) changes"


HOSPITAL = (
    "specializations doctors patients receptionists admin time_slots doctor_schedules appointment_statuses"
    " action_types appointments appointment_forms appointment_cancellations consultations prescribed_medicines"
    " consultation_actions room_types admissions beds rooms admitted_patient_visits discharges removed_doctors"
    " signin_logs signup_logs"
).split()


def long_lists(t: Tables, sample: Sample) -> Tables:
    """The hospital with reference lists of the size of the sample instead of fixed ones."""
    return t.replacing(
        specializations=sample.long_specializations,
        time_slots=sample.long_time_slots,
        action_types=sample.long_action_types,
        receptionists=sample.long_receptionists,
        room_types=sample.long_room_types,
    )


def hospital_tables(spark: SparkSession, folder: str) -> Tables:
    sample = Sample(spark, folder)
    frames: dict[str, Callable[[], DataFrame]] = {name: getattr(sample, name) for name in HOSPITAL}
    return Tables(frames)
