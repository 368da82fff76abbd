"""Independent SQL for the batch jobs and quality rules.

Sequential rules are written sequentially: booking walks each (doctor, day) group
request by request in a recursive statement.
"""

from __future__ import annotations

from checks.oracle import AS_OF, DOCTORS, ORACLE, SLOTS, TODAY
from checks.quality_oracle import QUALITY_ALL

JOB_ORACLE: dict[str, str] = {}


def new_id(table: str, key: str, requests: str, step: int = 1, alias: str = "r") -> str:
    return (
        f"(select max({key}) from {table}) + {step} * ({alias}.request_id - (select min(request_id) from {requests}) + 1)"
    )


# --- booking ---------------------------------------------------------------

_BOOK = f"""with recursive checked as (
  select r.*,
    coalesce(r.patient_id, 0) = 0 or coalesce(r.doctor_id, 0) = 0 or r.appointment_date is null
      or coalesce(r.slot_id, 0) = 0 incomplete,
    exists (select 1 from patients p where p.patient_id = r.patient_id) patient_known,
    exists (select 1 from doctors d where d.doctor_id = r.doctor_id) doctor_known,
    exists (select 1 from appointments a where a.patient_id = r.patient_id and a.doctor_id = r.doctor_id
      and a.appointment_date = r.appointment_date and a.status_id <> 3) pair_held,
    exists (select 1 from doctor_schedules s where s.doctor_id = r.doctor_id and s.slot_id = r.slot_id
      and s.day_of_week = dayofweek(r.appointment_date) and s.is_active) scheduled,
    exists (select 1 from appointments a where a.doctor_id = r.doctor_id and a.slot_id = r.slot_id
      and a.appointment_date = r.appointment_date and a.status_id <> 3) slot_held
  from booking_requests r),
candidates as (
  select request_id, requested_at, patient_id, doctor_id, appointment_date, slot_id,
    row_number() over (partition by doctor_id, appointment_date order by requested_at, request_id) n
  from checked where not incomplete and appointment_date between {TODAY} and {TODAY} + 7 and patient_known
    and doctor_known and not pair_held and scheduled and not slot_held),
walk as (
  select doctor_id, appointment_date, n, [slot_id] slots, [patient_id] people, [request_id] won
  from candidates where n = 1
  union all
  select w.doctor_id, w.appointment_date, c.n, case when f.free then list_append(w.slots, c.slot_id) else w.slots end,
    case when f.free then list_append(w.people, c.patient_id) else w.people end,
    case when f.free then list_append(w.won, c.request_id) else w.won end
  from walk w join candidates c on c.doctor_id = w.doctor_id and c.appointment_date = w.appointment_date
    and c.n = w.n + 1
  join lateral (select not list_contains(w.slots, c.slot_id) and not list_contains(w.people, c.patient_id) free) f
    on true),
accepted as (
  select c.* from candidates c where c.request_id in (select unnest(won) from (
    select won from walk qualify row_number() over (partition by doctor_id, appointment_date order by n desc) = 1))),
decided as (
  select r.request_id, r.requested_at, r.patient_id, r.doctor_id, r.appointment_date, r.slot_id, case
    when r.incomplete then 'patient_id, doctor_id, appointment_date, and slot_id are required'
    when r.appointment_date < {TODAY} then 'Cannot book appointments in the past'
    when r.appointment_date > {TODAY} + 7 then 'Appointments can only be booked up to 7 days in advance'
    when not r.patient_known then 'Patient not found'
    when not r.doctor_known then 'Doctor not found'
    when r.pair_held or exists (select 1 from accepted a where a.doctor_id = r.doctor_id
      and a.appointment_date = r.appointment_date and a.patient_id = r.patient_id and a.requested_at < r.requested_at)
      then 'Patient already has an appointment with this doctor on this date'
    when not r.scheduled then 'This slot is not in the doctor''s schedule for this day'
    when r.slot_held or exists (select 1 from accepted a where a.doctor_id = r.doctor_id
      and a.appointment_date = r.appointment_date and a.slot_id = r.slot_id and a.requested_at < r.requested_at)
      then 'This slot is already booked for the selected date' end reason
  from checked r)
"""
JOB_ORACLE["book_slots"] = _BOOK + f"""
select r.*, case when r.reason is null then {new_id("appointments", "appointment_id", "booking_requests")} end
  appointment_id, case when r.reason is null then 1 end status_id from decided r"""
JOB_ORACLE["book_slots_confirmations"] = _BOOK + f"""
select {new_id("appointments", "appointment_id", "booking_requests")} appointment_id, r.patient_id,
  concat(p.first_name, ' ', p.last_name) patient_name, p.phone_no patient_phone, r.doctor_id, d.doctor_name,
  d.specialization_name, r.appointment_date, cast(r.slot_id as bigint) slot_id, ts.start_time, ts.end_time,
  'Scheduled' status_name, d.consultation_fee, {AS_OF} created_at
from accepted r join patients p on p.patient_id = r.patient_id join {DOCTORS} d on d.doctor_id = r.doctor_id
join {SLOTS} ts on ts.slot_id = r.slot_id"""
JOB_ORACLE["advance_status"] = """
select a.appointment_id, c.consultation_id is not null consultation_exists, a.status_id previous_status,
  case when c.consultation_id is not null then 2 else coalesce(a.status_id, 1) end new_status, s.status_name
from appointments a left join consultations c on c.appointment_id = a.appointment_id
left join appointment_statuses s on s.status_id = case when c.consultation_id is not null then 2 else a.status_id end"""

# --- visits ----------------------------------------------------------------

_VISITS = f"""with recursive decided as (
  select r.*, a.admission_date, {new_id("admitted_patient_visits", "visit_id", "visit_requests")} new_id, case
    when coalesce(r.admission_id, 0) = 0 or coalesce(r.patient_id, 0) = 0 or coalesce(r.doctor_id, 0) = 0
      then 'Required fields missing'
    when a.admission_id is null then 'Active admission not found for the specified patient and doctor'
    when r.temperature < 90 or r.temperature > 110 then 'Temperature must be between 90 and 110°F'
    when r.oxygen_saturation < 0 or r.oxygen_saturation > 100 then 'Oxygen saturation must be between 0 and 100%'
    when r.pulse_rate < 0 or r.pulse_rate > 300 then 'Pulse rate must be between 0 and 300 BPM'
    when r.condition_status not in ('Stable', 'Improving', 'Critical', 'Deteriorating')
      then 'Condition status must be one of: Stable, Improving, Critical, Deteriorating' end reason
  from visit_requests r left join admissions a on a.admission_id = r.admission_id and a.patient_id = r.patient_id
    and a.doctor_id = r.doctor_id and a.is_active)
"""
JOB_ORACLE["record_visits"] = _VISITS + """
select request_id, admission_id, case when reason is null then new_id end visit_id, reason from decided"""
JOB_ORACLE["record_visits_rows"] = _VISITS + f"""
select new_id visit_id, admission_id, patient_id, doctor_id, {AS_OF} visit_datetime, blood_pressure,
  cast(nullif(temperature, 0) as decimal(5,2)) temperature, nullif(oxygen_saturation, 0) oxygen_saturation,
  nullif(pulse_rate, 0) pulse_rate, condition_status, cast(null as varchar) notes,
  cast(null as varchar) treatment_given, ready_for_discharge, discharge_recommended_date, {AS_OF} created_at
from decided where reason is null"""
JOB_ORACLE["record_visits_admissions"] = _VISITS + f"""
select a.* exclude (discharge_date), coalesce(x.until, a.discharge_date) discharge_date
from admissions a left join (
  select admission_id, coalesce(discharge_recommended_date, {AS_OF}) until from decided
  where reason is null and ready_for_discharge and coalesce(discharge_recommended_date, {AS_OF}) >= admission_date
  qualify row_number() over (partition by admission_id order by requested_at desc, request_id desc) = 1) x
  on x.admission_id = a.admission_id"""

# --- admission -------------------------------------------------------------

_ADMIT = f"""with recursive checked as (
  select r.*, b.room_id bed_room, b.is_occupied bed_taken,
    r.patient_id is null or r.patient_id = 0 or r.doctor_id = 0 or r.consultation_id = 0 or r.action_id = 0 incomplete,
    r.patient_id in (select patient_id from patients) and r.doctor_id in (select doctor_id from doctors)
      and r.consultation_id in (select consultation_id from consultations)
      and r.action_id in (select action_id from consultation_actions)
      and r.initial_room_id in (select room_id from rooms)
      and r.assigned_by_receptionist_id in (select receptionist_id from receptionists) known
  from admit_requests r left join beds b on b.bed_id = r.bed_id),
firsts as (
  select * from checked where not incomplete and bed_room is not null and not bed_taken and known
  qualify row_number() over (partition by bed_id order by requested_at, request_id) = 1),
decided as (
  select r.*, {new_id("admissions", "admission_id", "admit_requests")} new_id, case
    when r.incomplete then 'Required fields missing' when r.bed_room is null then 'Bed not found'
    when r.bed_taken or (f.requested_at, f.request_id) < (r.requested_at, r.request_id) then 'Bed is already occupied'
    when not r.known then 'Referenced row not found' end reason
  from checked r left join firsts f on f.bed_id = r.bed_id),
new_beds as (
  select b.* exclude (is_occupied), b.is_occupied or b.bed_id in (select bed_id from decided where reason is null)
    is_occupied from beds b)
"""
JOB_ORACLE["admit"] = _ADMIT + """
select request_id, bed_id, case when reason is null then new_id end admission_id, reason from decided"""
JOB_ORACLE["admit_actions"] = _ADMIT + f"""
select ca.* exclude (status), case when d.action_id is null then ca.status else 'Completed' end status,
  case when d.action_id is not null then {AS_OF} end completed_at
from consultation_actions ca left join (select distinct action_id from decided where reason is null) d
  on d.action_id = ca.action_id"""
JOB_ORACLE["admit_confirmations"] = _ADMIT + f"""
select d.new_id admission_id, d.patient_id, d.doctor_id, d.consultation_id, d.action_id,
  cast(d.initial_room_id as bigint) initial_room_id, cast(d.bed_id as bigint) bed_id, {AS_OF} admission_date,
  cast(null as timestamp) discharge_date, true is_active, d.admission_notes, d.assigned_by_receptionist_id,
  concat(p.first_name, ' ', p.last_name) patient_name, concat(o.first_name, ' ', o.last_name) doctor_name,
  r.room_number, b.bed_number, b.bed_code, k.type_name room_type
from decided d join patients p on p.patient_id = d.patient_id join doctors o on o.doctor_id = d.doctor_id
join rooms r on r.room_id = d.initial_room_id join room_types k on k.room_type_id = r.room_type_id
join beds b on b.bed_id = d.bed_id where d.reason is null"""
JOB_ORACLE["admit_rows"] = _ADMIT + f"""
select cast(new_id as bigint) admission_id, patient_id, doctor_id, consultation_id, action_id,
  cast(initial_room_id as bigint) initial_room_id, cast(bed_id as bigint) bed_id, {AS_OF} admission_date,
  cast(null as timestamp) discharge_date, true is_active, admission_notes, assigned_by_receptionist_id
from decided where reason is null"""
JOB_ORACLE["admit_beds"] = _ADMIT + "select * from new_beds"
JOB_ORACLE["admit_rooms"] = _ADMIT + """
select r.* exclude (is_occupied), r.is_occupied or (r.room_id in (select bed_room from decided where reason is null)
  and not exists (select 1 from new_beds b where b.room_id = r.room_id and not b.is_occupied)) is_occupied
from rooms r"""

JOB_ORACLE["stored_commit"] = _ADMIT + f"""
select 'admissions' table_name, admission_id id, cast(is_active as varchar) state from admissions
union all select 'admissions', cast(new_id as bigint), 'true' from decided where reason is null
union all select 'beds', cast(bed_id as bigint), cast(is_occupied as varchar) from new_beds
union all select 'rooms', cast(room_id as bigint), cast(is_occupied as varchar) from ({JOB_ORACLE["admit_rooms"][len(_ADMIT):]})
union all select 'consultation_actions', action_id,
  case when action_id in (select action_id from decided where reason is null) then 'Completed' else status end
from consultation_actions"""

# --- discharge -------------------------------------------------------------


def days(end: str) -> str:
    return f"cast(ceil((epoch_ms({end}) - epoch_ms(a.admission_date)) / 86400000.0) as int)"


_BILLED = "exists (select 1 from discharges x where x.admission_id = r.admission_id)"
_DESK = "r.{0} in (select receptionist_id from receptionists)"
_FIRST_VALID = """firsts as (
  select * from checked where own_reason is null
  qualify row_number() over (partition by admission_id order by requested_at, request_id) = 1),
"""
_TOTAL = f"""with recursive priced as (
  select r.request_id, r.requested_at, r.admission_id, r.bed_id, r.total_bill, r.discharged_by_receptionist_id,
    coalesce(r.discharge_date, {AS_OF}) discharge_date, a.patient_id, a.doctor_id, a.initial_room_id,
    greatest(1, {days(f"coalesce(r.discharge_date, {AS_OF})")}) total_days,
    cast(case when k.per_day_charges is null or k.per_day_charges = 0 then 1000 else k.per_day_charges end
      * greatest(1, {days(f"coalesce(r.discharge_date, {AS_OF})")}) as decimal(12,2)) room_charges
  from discharge_requests r left join admissions a on a.admission_id = r.admission_id and a.is_active
  left join rooms m on m.room_id = a.initial_room_id left join room_types k on k.room_type_id = m.room_type_id),
checked as (
  select r.* exclude (total_days, room_charges),
    case when r.patient_id is not null then total_days end total_days,
    case when r.patient_id is not null then room_charges end room_charges, case
    when r.bed_id = 0 or r.total_bill = 0 then 'Required fields missing'
    when r.patient_id is null then 'Active admission not found'
    when r.total_bill < r.room_charges then 'Invalid total_bill amount. Room charges exceed total bill.'
    when {_BILLED} then 'Duplicate key'
    when not {_DESK.format("discharged_by_receptionist_id")} then 'Referenced row not found' end own_reason
  from priced r),
{_FIRST_VALID}decided as (
  select r.*, {new_id("discharges", "discharge_id", "discharge_requests")} new_id,
    case when (f.requested_at, f.request_id) < (r.requested_at, r.request_id)
      and r.own_reason is distinct from 'Required fields missing' then 'Active admission not found'
      else r.own_reason end reason
  from checked r left join firsts f on f.admission_id = r.admission_id),
new_beds as (
  select b.* exclude (is_occupied),
    b.is_occupied and b.bed_id not in (select bed_id from decided where reason is null) is_occupied from beds b)
"""
JOB_ORACLE["discharge_total_bill"] = _TOTAL + """
select request_id, requested_at, case when reason is null then new_id end discharge_id, admission_id, patient_id,
  doctor_id, total_days, room_charges,
  cast(total_bill - room_charges as decimal(12,2)) medical_charges, total_bill, discharge_date, reason from decided"""
JOB_ORACLE["discharge_total_bill_rows"] = _TOTAL + """
select new_id discharge_id, admission_id, patient_id, doctor_id, discharge_date, total_days,
  cast(room_charges as decimal(10,2)) room_charges, cast(total_bill - room_charges as decimal(10,2)) medical_charges,
  cast(0 as decimal(10,2)) doctor_visit_charges, cast(0 as decimal(10,2)) lab_charges,
  cast(0 as decimal(10,2)) other_charges, cast(total_bill as decimal(10,2)) total_amount, 'Paid' payment_status,
  cast(total_bill as decimal(10,2)) amount_paid, cast(null as timestamp) payment_date,
  cast(null as varchar) final_diagnosis, cast(null as varchar) discharge_summary,
  cast(null as varchar) discharge_instructions, false follow_up_required, cast(null as date) follow_up_date,
  discharged_by_receptionist_id processed_by_receptionist_id, cast(null as bigint) discharge_approved_by_visit_id
from decided where reason is null"""
JOB_ORACLE["discharge_total_bill_admissions"] = _TOTAL + f"""
select a.* exclude (is_active, discharge_date), a.is_active and d.admission_id is null is_active,
  case when d.admission_id is null then a.discharge_date else {AS_OF} end discharge_date
from admissions a left join (select admission_id from decided where reason is null) d
  on d.admission_id = a.admission_id"""
JOB_ORACLE["discharge_total_bill_beds"] = _TOTAL + "select * from new_beds"
JOB_ORACLE["discharge_total_bill_rooms"] = _TOTAL + """
select r.* exclude (is_occupied), case when r.room_id in (select initial_room_id from decided where reason is null)
  then exists (select 1 from new_beds b where b.room_id = r.room_id and b.is_occupied) else r.is_occupied end
  is_occupied from rooms r"""
_ITEMISED = f"""with recursive checked as (
  select r.request_id, r.requested_at, r.admission_id, r.patient_id, r.doctor_id, r.processed_by_receptionist_id,
    {days(AS_OF)} total_days, cast(coalesce(r.room_charges, 0) as decimal(12,2)) room_charges, r.medical_charges,
    cast(0 as decimal(12,2)) doctor_visit_charges, r.lab_charges, cast(0 as decimal(12,2)) other_charges,
    cast(coalesce(r.room_charges, 0) + r.medical_charges + r.lab_charges as decimal(12,2)) total_amount, case
    when r.admission_id = 0 or r.patient_id = 0 or r.doctor_id = 0 then 'Required fields missing'
    when a.admission_id is null then 'Admission not found' when not a.is_active then 'Admission already discharged'
    when {days(AS_OF)} < 0 or r.lab_charges < 0 or r.medical_charges < 0 then 'Value breaks a table rule'
    when {_BILLED} then 'Duplicate key'
    when not ({_DESK.format("processed_by_receptionist_id")} and r.patient_id in (select patient_id from patients)
      and r.doctor_id in (select doctor_id from doctors)) then 'Referenced row not found' end own_reason
  from discharge_requests r left join admissions a on a.admission_id = r.admission_id),
{_FIRST_VALID}decided as (
  select r.* exclude (own_reason), case when (f.requested_at, f.request_id) < (r.requested_at, r.request_id)
      and r.own_reason is distinct from 'Required fields missing' then 'Admission already discharged'
      else r.own_reason end reason
  from checked r left join firsts f on f.admission_id = r.admission_id)
"""
JOB_ORACLE["discharge_itemised"] = _ITEMISED + f"""
select r.*, case when reason is null then {new_id("discharges", "discharge_id", "discharge_requests")} end discharge_id
from decided r"""
_FINAL = f"""with recursive checked as (
  select r.request_id, r.requested_at, r.admission_id, a.patient_id, a.doctor_id, {days(AS_OF)} total_days,
    r.final_bill_amount, case
    when r.admission_id = 0 or r.final_bill_amount = 0 then 'Required fields missing'
    when a.admission_id is null then 'Active admission not found'
    when {days(AS_OF)} < 0 or r.final_bill_amount < 0 then 'Value breaks a table rule'
    when {_BILLED} then 'Duplicate key'
    when not {_DESK.format("discharged_by_receptionist_id")} then 'Referenced row not found' end own_reason
  from discharge_requests r left join admissions a on a.admission_id = r.admission_id and a.is_active),
{_FIRST_VALID}decided as (
  select r.* exclude (own_reason), case when (f.requested_at, f.request_id) < (r.requested_at, r.request_id)
      and r.own_reason is distinct from 'Required fields missing' then 'Active admission not found'
      else r.own_reason end reason
  from checked r left join firsts f on f.admission_id = r.admission_id)
"""
JOB_ORACLE["discharge_final_amount"] = _FINAL + f"""
select r.*, case when reason is null then {new_id("discharges", "discharge_id", "discharge_requests")} end discharge_id
from decided r"""
_CLOSED = f"""
select a.* exclude (is_active, discharge_date), a.is_active and d.admission_id is null is_active,
  case when d.admission_id is null then a.discharge_date else {AS_OF} end discharge_date
from admissions a left join (select admission_id from decided where reason is null) d
  on d.admission_id = a.admission_id"""


def bill_rows(room: str, medical: str, lab: str, total: str, desk: str) -> str:
    """New unpaid discharges of the accepted requests."""
    amounts = {
        "room_charges": room, "medical_charges": medical, "doctor_visit_charges": "0", "lab_charges": lab,
        "other_charges": "0", "total_amount": total, "amount_paid": "0",
    }
    listed = ", ".join(f"cast({value} as decimal(10,2)) {name}" for name, value in amounts.items())
    return f"""
    select {new_id("discharges", "discharge_id", "discharge_requests")} discharge_id, admission_id, patient_id, doctor_id,
      {AS_OF} discharge_date, cast(total_days as int) total_days, {listed}, 'Unpaid' payment_status,
      cast(null as timestamp) payment_date, cast(null as varchar) final_diagnosis, cast(null as varchar) discharge_summary,
      cast(null as varchar) discharge_instructions, false follow_up_required, cast(null as date) follow_up_date,
      {desk} processed_by_receptionist_id, cast(null as bigint) discharge_approved_by_visit_id
    from (select * from decided where reason is null) r"""


JOB_ORACLE["discharge_itemised_rows"] = _ITEMISED + bill_rows(
    "room_charges", "medical_charges", "lab_charges", "total_amount", "processed_by_receptionist_id"
)
JOB_ORACLE["discharge_itemised_admissions"] = _ITEMISED + _CLOSED
JOB_ORACLE["discharge_final_amount_rows"] = _FINAL + bill_rows(
    "0", "final_bill_amount", "0", "final_bill_amount",
    "(select q.discharged_by_receptionist_id from discharge_requests q where q.request_id = r.request_id)",
)
JOB_ORACLE["discharge_final_amount_admissions"] = _FINAL + _CLOSED
JOB_ORACLE["discharge_final_amount_beds"] = _FINAL + """
select b.* exclude (is_occupied), b.is_occupied and b.bed_id not in (select a.bed_id from admissions a
  join decided d on d.admission_id = a.admission_id where d.reason is null) is_occupied from beds b"""
JOB_ORACLE["discharge_final_amount_rooms"] = _FINAL + """
select r.* exclude (is_occupied), r.is_occupied and r.room_id not in (select a.initial_room_id from admissions a
  join decided d on d.admission_id = a.admission_id where d.reason is null) is_occupied from rooms r"""

# --- occupancy -------------------------------------------------------------

JOB_ORACLE["room_occupancy"] = """
select r.*, coalesce(bool_and(b.is_occupied), false) room_full, coalesce(bool_or(b.is_occupied), false) room_in_use
from rooms r left join beds b on b.room_id = r.room_id group by all"""
JOB_ORACLE["set_bed_flags_rooms"] = """with recursive flags as (
  select bed_id, is_occupied from bed_requests where bed_id in (select bed_id from beds)
  qualify row_number() over (partition by bed_id order by requested_at desc, request_id desc) = 1),
new_beds as (
  select b.room_id, f.bed_id is not null touched, coalesce(f.is_occupied, b.is_occupied) is_occupied
  from beds b left join flags f on f.bed_id = b.bed_id),
full_rooms as (select room_id, bool_and(is_occupied) full_room, bool_or(touched) touched from new_beds group by room_id)
select r.* exclude (is_occupied), case when x.touched then x.full_room else r.is_occupied end is_occupied
from rooms r left join full_rooms x on x.room_id = r.room_id"""

# Request by request, each step carrying all beds of the room on.
JOB_ORACLE["set_bed_flags_one_way_rooms"] = """with recursive steps as (
  select b.room_id, q.bed_id, q.is_occupied flag,
    row_number() over (partition by b.room_id order by q.requested_at, q.request_id) n
  from bed_requests q join beds b on b.bed_id = q.bed_id),
walk as (
  select bed_id, room_id, is_occupied taken, cast(0 as bigint) n, false filled
  from beds where room_id in (select room_id from steps)
  union all
  select bed_id, room_id, taken, n, flag and bool_and(taken) over (partition by room_id)
  from (select w.bed_id, w.room_id, case when w.bed_id = s.bed_id then s.flag else w.taken end taken, s.n, s.flag
    from walk w join steps s on s.room_id = w.room_id and s.n = w.n + 1))
select r.* exclude (is_occupied), r.is_occupied or coalesce(x.filled, false) is_occupied
from rooms r left join (select room_id, bool_or(filled) filled from walk group by room_id) x on x.room_id = r.room_id"""

JOB_ORACLE["set_room_flags_rooms"] = """
select r.* exclude (is_occupied), coalesce(x.is_occupied, r.is_occupied) is_occupied
from rooms r left join (select room_id, is_occupied from room_requests
  qualify row_number() over (partition by room_id order by requested_at desc, request_id desc) = 1) x
  on x.room_id = r.room_id"""

# --- patches ---------------------------------------------------------------


def newest(value: str, given: str) -> str:
    return f"(max({{'at': requested_at, 'id': request_id, 'v': {value}}}) filter (where {given}))['v']"


# Patches of a doctor one by one over all rows of the doctor: each step carries every row on.
_SCHEDULE_PATCH = """with recursive checked as (
  select p.*, s.doctor_id, case when not (has_day or has_slot or has_active) then 'No fields to update'
    when s.schedule_id is null then 'Not found' when has_day and new_day > 6 then 'Value breaks a table rule'
    when has_slot and new_slot not in (select slot_id from time_slots) then 'Referenced row not found' end early
  from schedule_patches p left join doctor_schedules s on s.schedule_id = p.schedule_id),
steps as (
  select *, row_number() over (partition by doctor_id order by requested_at, request_id) n
  from checked where early is null and (has_day or has_slot)),
walk as (
  select schedule_id, doctor_id, cast(day_of_week as int) d, cast(slot_id as int) s, cast(0 as bigint) n,
    cast(null as bigint) refused
  from doctor_schedules where doctor_id in (select doctor_id from steps)
  union all
  select schedule_id, doctor_id, case when here and not taken then to_d else d end,
    case when here and not taken then to_s else s end, n, case when here and taken then request_id end
  from (select *, bool_or(not here and d = to_d and s = to_s) over (partition by doctor_id) taken
    from (select *, max(case when here then case when has_day then new_day else d end end) over (partition by doctor_id) to_d,
        max(case when here then case when has_slot then new_slot else s end end) over (partition by doctor_id) to_s
      from (select w.schedule_id, w.doctor_id, w.d, w.s, p.n, p.request_id, p.has_day, p.new_day, p.has_slot, p.new_slot,
          w.schedule_id = p.schedule_id here
        from walk w join steps p on p.doctor_id = w.doctor_id and p.n = w.n + 1)))),
decided as (
  select c.*, case when r.refused is not null then 'Duplicate key' else early end reason
  from checked c left join (select refused from walk where refused is not null) r on r.refused = c.request_id)
"""
JOB_ORACLE["patch_schedules_decisions"] = _SCHEDULE_PATCH + "select request_id, schedule_id, reason from decided"
JOB_ORACLE["patch_schedules"] = _SCHEDULE_PATCH + f"""
select s.schedule_id, s.doctor_id, case when x.d then x.new_day else s.day_of_week end day_of_week,
  case when x.s then x.new_slot else s.slot_id end slot_id, case when x.a then x.new_active else s.is_active end is_active,
  cast(null as timestamp) created_at, case when x.schedule_id is not null then {AS_OF} end updated_at
from doctor_schedules s left join (
  select schedule_id, bool_or(has_day) d, bool_or(has_slot) s, bool_or(has_active) a,
    {newest("new_day", "has_day")} new_day, {newest("new_slot", "has_slot")} new_slot,
    {newest("new_active", "has_active")} new_active
  from decided where reason is null group by schedule_id) x on x.schedule_id = s.schedule_id"""
JOB_ORACLE["patch_actions"] = f"""
select a.* exclude (status, notes), case when x.s then x.new_status else a.status end status,
  case when x.n then x.new_notes else a.notes end notes, case when x.done then {AS_OF} end completed_at
from consultation_actions a left join (
  select action_id, bool_or(has_status) s, bool_or(has_notes) n, {newest("new_status", "has_status")} new_status,
    {newest("new_notes", "has_notes")} new_notes, bool_or(has_status and new_status = 'Completed') done
  from action_patches where (has_status or has_notes) and not (has_status and new_status = 'Open')
  group by action_id) x on x.action_id = a.action_id"""
JOB_ORACLE["patch_visits"] = f"""
select v.* exclude (temperature, pulse_rate, condition_status, ready_for_discharge),
  cast(case when x.t then 98.60 else cast(v.temperature as decimal(5,2)) end as double) temperature,
  case when x.p then x.new_pulse else v.pulse_rate end pulse_rate,
  case when x.c then null else v.condition_status end condition_status,
  case when x.r then x.new_ready else v.ready_for_discharge end ready_for_discharge,
  cast(null as varchar) notes, cast(null as varchar) treatment_given, cast(null as timestamp) created_at
from admitted_patient_visits v left join (
  select visit_id, bool_or(has_temperature) t, bool_or(has_pulse) p, bool_or(has_condition) c, bool_or(has_ready) r,
    {newest("new_pulse", "has_pulse")} new_pulse, {newest("new_ready", "has_ready")} new_ready
  from visit_patches
  where not (has_temperature and new_temperature = 'hot') and not (has_pulse and new_pulse > 300) group by visit_id) x
  on x.visit_id = v.visit_id"""
JOB_ORACLE["patch_follow_up"] = f"""
select d.* exclude (follow_up_required),
  case when x.r then x.new_required else d.follow_up_required end follow_up_required,
  case when x.d then date '2001-09-01' end follow_up_date, case when x.n then x.new_notes end discharge_instructions,
  cast(null as timestamp) payment_date, cast(null as varchar) discharge_summary,
  cast(null as bigint) discharge_approved_by_visit_id
from discharges d left join (
  select discharge_id, bool_or(has_required) r, bool_or(has_date) d, bool_or(has_notes) n,
    {newest("new_required", "has_required")} new_required, {newest("new_notes", "has_notes")} new_notes
  from follow_up_patches group by discharge_id) x on x.discharge_id = d.discharge_id"""

# --- removal ---------------------------------------------------------------

_REMOVAL = f"""with recursive held as (
  select doctor_id from admissions union select doctor_id from admitted_patient_visits
  union select doctor_id from discharges
  union select a.doctor_id from appointments a join consultations c on c.appointment_id = a.appointment_id
    join admissions x on x.consultation_id = c.consultation_id
  union select c.doctor_id from consultations c join appointments a on a.appointment_id = c.appointment_id
    where a.doctor_id <> c.doctor_id),
checked as (
  select r.*, removal_reason = '' or coalesce(removed_by_admin_id, 0) = 0 incomplete, case
    when removal_reason = '' or coalesce(removed_by_admin_id, 0) = 0 then 'Required fields missing'
    when r.doctor_id not in (select doctor_id from doctors) then 'Doctor not found'
    when r.removed_by_admin_id not in (select admin_id from admin) then 'Referenced row not found'
    when r.doctor_id in (select doctor_id from held) then 'Referenced by other rows' end own_reason
  from removal_requests r),
firsts as (select * from checked where own_reason is null
  qualify row_number() over (partition by doctor_id order by requested_at, request_id) = 1),
decided as (
  select r.* exclude (incomplete, own_reason), case
    when f.requested_at < r.requested_at and not r.incomplete then 'Doctor not found' else r.own_reason end reason
  from checked r left join firsts f on f.doctor_id = r.doctor_id),
gone as (select doctor_id from decided where reason is null)
"""
JOB_ORACLE["remove_doctors"] = _REMOVAL + f"""
select r.*, case when reason is null then {new_id("removed_doctors", "removed_doctor_id", "removal_requests")} end
  removed_doctor_id from decided r"""
JOB_ORACLE["remove_doctors_appointments"] = _REMOVAL + """
select *, cast(null as timestamp) appointment_datetime from appointments
where doctor_id not in (select doctor_id from gone)"""
JOB_ORACLE["remove_doctors_medicines"] = _REMOVAL + """
select m.* from prescribed_medicines m join consultations c on c.consultation_id = m.consultation_id
join appointments a on a.appointment_id = c.appointment_id where a.doctor_id not in (select doctor_id from gone)"""
JOB_ORACLE["remove_doctors_rows"] = _REMOVAL + f"""
select {new_id("removed_doctors", "removed_doctor_id", "removal_requests")} removed_doctor_id, doctor_id,
  concat(d.first_name, ' ', d.last_name) doctor_name, cast(d.specialization_id as bigint) specialization_id,
  d.registration_number, r.removal_reason,
  cast(r.removed_by_admin_id as bigint) removed_by_admin_id, {AS_OF} removal_date
from (select * from decided where reason is null) r join doctors d using (doctor_id)"""
_STAYING = "(select appointment_id from appointments where doctor_id not in (select doctor_id from gone))"
JOB_ORACLE["remove_doctors_doctors"] = _REMOVAL + "select * from doctors where doctor_id not in (select doctor_id from gone)"
JOB_ORACLE["remove_doctors_schedules"] = _REMOVAL + """
select *, cast(null as timestamp) created_at, cast(null as timestamp) updated_at from doctor_schedules
where doctor_id not in (select doctor_id from gone)"""
for _name, _table in (
    ("forms", "appointment_forms"), ("cancellations", "appointment_cancellations"), ("consultations", "consultations"),
):
    JOB_ORACLE[f"remove_doctors_{_name}"] = _REMOVAL + f"select * from {_table} where appointment_id in {_STAYING}"
JOB_ORACLE["remove_doctors_actions"] = _REMOVAL + f"""
select x.*, cast(null as timestamp) completed_at from consultation_actions x
join consultations c on c.consultation_id = x.consultation_id where c.appointment_id in {_STAYING}"""
JOB_ORACLE["delete_schedules"] = """
select request_id, requested_at, schedule_id, case when schedule_id not in (select schedule_id from doctor_schedules)
  or row_number() over (partition by schedule_id order by requested_at, request_id) > 1 then 'Not found' end reason
from schedule_deletions"""
JOB_ORACLE["delete_schedules_state"] = """
select s.*, cast(null as timestamp) created_at, cast(null as timestamp) updated_at from doctor_schedules s
where schedule_id not in (select schedule_id from schedule_deletions)"""

JOB_ORACLE["delete_time_slots"] = """
select request_id, requested_at, slot_id, case when slot_id not in (select slot_id from time_slots)
  or row_number() over (partition by slot_id order by requested_at, request_id) > 1 then 'Not found' end reason
from slot_deletions"""
JOB_ORACLE["delete_time_slots_schedules"] = """
select s.*, cast(null as timestamp) created_at, cast(null as timestamp) updated_at from doctor_schedules s
where slot_id not in (select slot_id from slot_deletions)"""
JOB_ORACLE["delete_time_slots_appointments"] = """
select * exclude (slot_id), cast(null as timestamp) appointment_datetime,
  case when slot_id not in (select slot_id from slot_deletions) then slot_id end slot_id from appointments"""

# --- ingest ----------------------------------------------------------------

_NEW_PATIENTS = f"""with recursive decided as (
  select r.*, {new_id("patients", "patient_id", "new_patients")} new_id, case
    when first_name = '' or coalesce(age, 0) = 0 then 'Required fields missing'
    when age > 150 or gender = 'None' then 'Value breaks a table rule' end reason
  from new_patients r)
"""
JOB_ORACLE["ingest_patients"] = _NEW_PATIENTS + """
select request_id, requested_at, case when reason is null then new_id end patient_id,
  case when reason is null then concat('P', new_id) end patient_login_id, first_name, last_name, age, gender,
  nullif(blood_group, '') blood_group, cast(null as varchar) phone_no, reason from decided"""
JOB_ORACLE["ingest_patients_signups"] = _NEW_PATIENTS + f"""
select {new_id("signup_logs", "signup_log_id", "new_patients")} signup_log_id, new_id patient_id, first_name,
  last_name, {AS_OF} signup_datetime from decided r where reason is null"""
_NEW_DOCTORS = f"""with recursive checked as (
  select r.*, case when specialization_id = 0 or experience_years = 0 or age = 0 then 'Required fields missing'
    when exists (select 1 from doctors d where d.registration_number is not distinct from r.registration_number)
      then 'Duplicate key'
    when age < 18 or age > 100 then 'Value breaks a table rule'
    when specialization_id not in (select specialization_id from specializations) then 'Referenced row not found'
    end own_reason
  from new_doctors r),
decided as (
  select r.*, {new_id("doctors", "doctor_id", "new_doctors", 10)} new_id, case when own_reason is null and
    row_number() over (partition by registration_number, own_reason is null order by requested_at, request_id) > 1
    then 'Duplicate key' else own_reason end reason
  from checked r)
"""
JOB_ORACLE["ingest_doctors"] = _NEW_DOCTORS + """
select request_id, requested_at, case when reason is null then new_id end doctor_id,
  case when reason is null then concat('D', new_id) end doctor_login_id, first_name, last_name, age,
  cast(specialization_id as bigint) specialization_id, experience_years, consultation_fee,
  cast(null as varchar) phone_no, registration_number, reason from decided"""
JOB_ORACLE["ingest_doctors_rows"] = _NEW_DOCTORS + """
select new_id doctor_id, concat('D', new_id) doctor_login_id, first_name, last_name, age,
  cast(specialization_id as bigint) specialization_id, consultation_fee, cast(null as varchar) phone_no,
  experience_years, registration_number,
  cast((select max(room_no) from doctors) + request_id + 1 as int) room_no
from decided where reason is null"""
JOB_ORACLE["ingest_forms"] = f"""with recursive checked as (
  select r.*, case when coalesce(r.appointment_id, 0) = 0 or coalesce(r.patient_id, 0) = 0 or r.symptoms is null
      then 'Required fields missing'
    when not exists (select 1 from appointments a where a.appointment_id = r.appointment_id
      and a.patient_id = r.patient_id) then 'Appointment not found or does not belong to this patient'
    when r.appointment_id in (select appointment_id from appointment_forms)
      then 'Appointment form already exists for this appointment' end own_reason
  from new_forms r),
decided as (
  select r.* exclude (own_reason), case when own_reason is null and
    row_number() over (partition by appointment_id, own_reason is null order by requested_at, request_id) > 1
    then 'Appointment form already exists for this appointment' else own_reason end reason
  from checked r)
select r.*, cast(null as varchar) medical_history,
  case when reason is null then {new_id("appointment_forms", "form_id", "new_forms")} end form_id
from decided r"""

JOB_ORACLE["ingest_consultations"] = f"""with recursive checked as (
  select r.*, case when coalesce(r.appointment_id, 0) = 0 or coalesce(r.doctor_id, 0) = 0 or coalesce(r.patient_id, 0) = 0
      then 'Required fields missing'
    when r.appointment_id in (select appointment_id from consultations) then 'Duplicate key'
    when r.doctor_id not in (select doctor_id from doctors) then 'Referenced row not found' end own_reason
  from new_consultations r),
decided as (
  select r.* exclude (own_reason, blood_pressure, temperature), nullif(blood_pressure, '') blood_pressure,
    cast(nullif(temperature, 0) as decimal(5,2)) temperature, case when own_reason is null and
    row_number() over (partition by appointment_id, own_reason is null order by requested_at, request_id) > 1
    then 'Duplicate key' else own_reason end reason
  from checked r)
select r.*, cast(null as int) oxygen_saturation, cast(null as varchar) diagnosis,
  case when reason is null then {new_id("consultations", "consultation_id", "new_consultations")} end consultation_id
from decided r"""
JOB_ORACLE["ingest_schedules"] = f"""with recursive valid as (
  select r.* from new_schedules r
  where coalesce(doctor_id, 0) <> 0 and day_of_week between 0 and 6 and coalesce(slot_id, 0) <> 0
    and doctor_id in (select doctor_id from doctors) and slot_id in (select slot_id from time_slots)
    and not exists (select 1 from doctor_schedules s where s.doctor_id = r.doctor_id
      and s.day_of_week = r.day_of_week and s.slot_id = r.slot_id)
  qualify row_number() over (partition by doctor_id, day_of_week, slot_id order by requested_at, request_id) = 1)
select {new_id("doctor_schedules", "schedule_id", "new_schedules")} schedule_id, doctor_id, day_of_week,
  cast(slot_id as bigint) slot_id, coalesce(is_active, true) is_active, {AS_OF} created_at, {AS_OF} updated_at
from valid r"""
JOB_ORACLE["ingest_medicines"] = f"""with recursive decided as (
  select r.*, case when coalesce(consultation_id, 0) = 0 or dosage = '' then 'Required fields missing'
    when length(frequency) > 50 then 'Value breaks a table rule'
    when consultation_id not in (select consultation_id from consultations) then 'Referenced row not found' end reason
  from new_medicines r)
select r.*, case when reason is null then {new_id("prescribed_medicines", "medicine_id", "new_medicines")} end medicine_id
from decided r"""

JOB_ORACLE["ingest_receptionists"] = f"""
select {new_id("receptionists", "receptionist_id", "new_receptionists")} receptionist_id,
  concat('R', {new_id("receptionists", "receptionist_id", "new_receptionists")}) receptionist_login_id, first_name,
  last_name, nullif(contact_no, '') contact_no, {AS_OF} created_at
from new_receptionists r where last_name is not null"""
JOB_ORACLE["ingest_actions"] = f"""with recursive decided as (
  select r.*, case when consultation_id = 0 or action_type_id = 0 then 'Required fields missing'
    when consultation_id not in (select consultation_id from consultations)
      or action_type_id not in (select action_type_id from action_types) then 'Referenced row not found' end reason
  from new_actions r)
select r.*, case when reason is null then {new_id("consultation_actions", "action_id", "new_actions")} end action_id
from decided r"""
JOB_ORACLE["ingest_signins"] = f"""
select {new_id("signin_logs", "log_id", "new_signins")} log_id, user_id, user_type, {AS_OF} signin_datetime
from new_signins r where user_type is not null"""



def _decided(name: str) -> str:
    """The statement of an ingest up to its decisions."""
    return JOB_ORACLE[name].rsplit("\nselect", 1)[0]


JOB_ORACLE["ingest_patients_rows"] = _NEW_PATIENTS + f"""
select new_id patient_id, concat('P', new_id) patient_login_id, first_name, last_name, age, gender,
  nullif(blood_group, '') blood_group, cast(null as varchar) phone_no, {AS_OF} created_at
from decided where reason is null"""
JOB_ORACLE["ingest_forms_rows"] = _decided("ingest_forms") + f"""
select {new_id("appointment_forms", "form_id", "new_forms")} form_id, appointment_id, patient_id, symptoms,
  cast(null as varchar) medical_history, {AS_OF} created_at from decided r where reason is null"""
JOB_ORACLE["ingest_consultations_rows"] = _decided("ingest_consultations") + f"""
select {new_id("consultations", "consultation_id", "new_consultations")} consultation_id, appointment_id, doctor_id, patient_id,
  blood_pressure, temperature, cast(null as int) oxygen_saturation, cast(null as varchar) diagnosis, {AS_OF} consultation_date
from decided r where reason is null"""
JOB_ORACLE["ingest_medicines_rows"] = _decided("ingest_medicines") + f"""
select {new_id("prescribed_medicines", "medicine_id", "new_medicines")} medicine_id, consultation_id, medicine_name, dosage,
  frequency, duration, {AS_OF} created_at from decided r where reason is null"""
JOB_ORACLE["ingest_actions_rows"] = _decided("ingest_actions") + f"""
select {new_id("consultation_actions", "action_id", "new_actions")} action_id, consultation_id, action_type_id,
  'Pending' status, notes, {AS_OF} created_at, cast(null as timestamp) completed_at from decided r where reason is null"""

# --- quality ---------------------------------------------------------------

JOB_ORACLE["quality_visits"] = """
select * from (
  select 'admitted_patient_visits' "table", 'range:temperature' rule, count(*) violations from raw_visits
    where temperature not between 90 and 110
  union all select 'admitted_patient_visits', 'range:pulse_rate', count(*) from raw_visits
    where pulse_rate not between 0 and 300
  union all select 'admitted_patient_visits', 'range:oxygen_saturation', count(*) from raw_visits
    where oxygen_saturation not between 0 and 100
  union all select 'admitted_patient_visits', 'list:condition_status', count(*) from raw_visits
    where condition_status not in ('Stable', 'Improving', 'Critical', 'Deteriorating')
  union all select 'admitted_patient_visits', 'not_null:doctor_id', count(*) from raw_visits where doctor_id is null
  union all select 'admitted_patient_visits', 'positive_id:' || c, n from (
    select 'visit_id' c, count(*) filter (where visit_id <= 0) n from raw_visits
    union all select 'admission_id', count(*) filter (where admission_id <= 0) from raw_visits
    union all select 'patient_id', count(*) filter (where patient_id <= 0) from raw_visits
    union all select 'doctor_id', count(*) filter (where doctor_id <= 0) from raw_visits)
  union all select 'admitted_patient_visits', 'unique:visit_id', count(*)
    from (select visit_id from raw_visits group by visit_id having count(*) > 1)
  union all select 'admitted_patient_visits', 'reference:admission_id', count(*) from raw_visits
    where admission_id not in (select admission_id from admissions)
  union all select 'admitted_patient_visits', 'reference:patient_id', count(*) from raw_visits
    where patient_id not in (select patient_id from patients)
  union all select 'admitted_patient_visits', 'reference:doctor_id', count(*) from raw_visits
    where doctor_id is not null and doctor_id not in (select doctor_id from doctors))
where violations > 0"""


def _zero(table: str, key: str, *columns: str) -> str:
    """In the sample the keys start at 0, the one rule its core tables break."""
    return " union all ".join(
        f"""select '{table}' "table", 'positive_id:{c}' rule, cast({key} as varchar) "key", cast({c} as varchar) detail
        from {table} where {c} <= 0"""
        for c in (key, *columns)
    )


JOB_ORACLE["quality_core"] = " union all ".join(
    [
        _zero("appointments", "appointment_id", "patient_id", "doctor_id", "slot_id", "status_id"),
        _zero("consultations", "consultation_id", "appointment_id", "doctor_id", "patient_id"),
        _zero("admissions", "admission_id", "patient_id", "doctor_id", "consultation_id", "action_id",
              "initial_room_id", "bed_id", "assigned_by_receptionist_id"),
        _zero("discharges", "discharge_id", "admission_id", "patient_id", "doctor_id",
              "processed_by_receptionist_id"),
        _zero("doctors", "doctor_id", "specialization_id"),
        _zero("patients", "patient_id"),
        """select 'consultations', 'unique:appointment_id', cast(min(consultation_id) as varchar), count(*) || ' rows'
           from consultations group by appointment_id having count(*) > 1""",
        """select 'discharges', 'unique:admission_id', cast(min(discharge_id) as varchar), count(*) || ' rows'
           from discharges group by admission_id having count(*) > 1""",
        """select 'admissions', 'discharge_after_admission:discharge_date', cast(admission_id as varchar),
           cast(discharge_date as varchar) from admissions where discharge_date < admission_date""",
    ]
)

JOB_ORACLE["quality_all"] = QUALITY_ALL

JOB_ORACLE["stored_update"] = JOB_ORACLE["patch_follow_up"]

# Kept-up totals equal the direct query on the tables they end with.
JOB_ORACLE["patients_range_indexed"] = ORACLE["patients_range"]
for _name in ("range_summary", "doctor_visits_summary", "doctor_discharge_stats"):
    JOB_ORACLE[f"{_name}_from_days"] = ORACLE[_name]
JOB_ORACLE["doctor_patients_from_days"] = """
select doctor_id, count(distinct patient_id) patients from appointments
where appointment_date between date '1999-01-01' and date '1999-03-31' group by doctor_id"""
