"""Independent SQL for every dataset, over the views of ``checks.views``.

Reports use the plain join form here (the row product of all facts), so the
per-person counts of the Spark side are checked against the real thing.
"""

from __future__ import annotations

import re

from checks.views import VIEWS

AS_OF = "timestamp '2001-08-01 00:00:00'"
TODAY = "date '2001-08-01'"
DAY = "date '1999-03-15'"
START, END = "date '1999-01-01'", "date '1999-03-31'"
END_SECOND = "timestamp '1999-03-31 23:59:59'"


def missing(alias_types: str) -> str:
    """Declared columns the sample lacks, as typed NULLs: ``name:type name:type``."""
    pairs = [p.split(":") for p in alias_types.split()]
    return ", ".join(f"cast(null as {kind}) as {name}" for name, kind in pairs)


SPECIALIZATION_X = missing("specialization_login_id:varchar description:varchar")
SCHEDULE_X = missing("created_at:timestamp updated_at:timestamp")
VISIT_X = missing("notes:varchar treatment_given:varchar created_at:timestamp")
DISCHARGE_X = missing(
    "payment_date:timestamp discharge_summary:varchar discharge_instructions:varchar follow_up_date:date"
    " discharge_approved_by_visit_id:bigint"
)
ACTION_X = missing("completed_at:timestamp")
KIND_X = missing("description:varchar")

SLOTS = """(select slot_id, slot_number,
  printf('%02d:%02d:00', start_min // 60, start_min % 60) start_time,
  printf('%02d:%02d:00', end_min // 60, end_min % 60) end_time from time_slots)"""
LONG_SLOTS = SLOTS.replace("from time_slots", "from long_time_slots")
DOCTORS = """(select d.*, concat(d.first_name, ' ', d.last_name) doctor_name, s.specialization_name
  from doctors d join specializations s using (specialization_id))"""
PATIENTS = "(select *, concat(first_name, ' ', last_name) patient_name from patients)"
TAKEN = "(select distinct doctor_id, appointment_date, slot_id from appointments where status_id <> 3)"

ORACLE: dict[str, str] = {}

# --- lists -----------------------------------------------------------------

ORACLE["specializations"] = f"select *, {SPECIALIZATION_X} from long_specializations"
ORACLE["doctor_directory"] = "select d.*, s.specialization_name from doctors d join specializations s using (specialization_id)"
ORACLE["doctors_list"] = f"""
select doctor_id, doctor_login_id, doctor_name, specialization_name, consultation_fee from {DOCTORS}"""
ORACLE["doctor_fees"] = "select doctor_id, consultation_fee from doctors"
ORACLE["removed_doctors"] = """
select rd.*, cast(null as varchar) registration_number, a.username removed_by_admin, s.specialization_name
from removed_doctors rd left join admin a on a.admin_id = rd.removed_by_admin_id
left join specializations s on s.specialization_id = rd.specialization_id"""
ORACLE["time_slots"] = f"select * from {LONG_SLOTS}"
ORACLE["action_types"] = "select * from long_action_types"
ORACLE["receptionists"] = "select *, cast(null as timestamp) created_at from long_receptionists"
ORACLE["reference_dims"] = f"""
select 'time_slots' dimension, cast(slot_id as bigint) id, start_time || '-' || end_time as label from {LONG_SLOTS}
union all select 'action_types', action_type_id, action_name from long_action_types
union all select 'receptionists', receptionist_id, first_name || ' ' || last_name from long_receptionists"""
ORACLE["recent_signins"] = """
select user_id, user_type, strftime(signin_datetime, '%Y-%m-%d %H:%M') signin_time
from signin_logs order by signin_datetime desc nulls last, log_id desc limit 20"""
ORACLE["recent_patients"] = """
select patient_id, patient_login_id, concat(first_name, ' ', last_name) patient_name, age, gender,
  strftime(created_at, '%Y-%m-%d') registered_date
from patients order by created_at desc nulls last, patient_id desc limit 50"""

# --- scheduling ------------------------------------------------------------

ORACLE["schedules"] = f"""
select ds.*, {SCHEDULE_X}, ts.slot_number, ts.start_time, ts.end_time,
  concat(d.first_name, ' ', d.last_name) doctor_name, d.doctor_login_id, d.room_no
from doctor_schedules ds join {SLOTS} ts using (slot_id) join doctors d using (doctor_id)"""

_AVAILABLE = f"""
select ds.schedule_id, ds.doctor_id, ds.slot_id, ds.day_of_week, ts.start_time, ts.end_time,
  case when b.slot_id is null then 1 else 0 end is_available,
  case when b.slot_id is null then 'Available' else 'Booked' end slot_status
from doctor_schedules ds join {SLOTS} ts using (slot_id)
left join {TAKEN} b on b.doctor_id = ds.doctor_id and b.slot_id = ds.slot_id and b.appointment_date = {TODAY}
where ds.is_active and ds.day_of_week = dayofweek({TODAY})"""
ORACLE["available_schedule"] = _AVAILABLE
ORACLE["available_schedule_summary"] = f"""
select d.doctor_id, d.doctor_name, d.specialization_name, d.consultation_fee, {TODAY} "date",
  cast(coalesce(sum(x.is_available), 0) as bigint) available_count, count(x.schedule_id) total_slots
from {DOCTORS} d left join ({_AVAILABLE}) x on x.doctor_id = d.doctor_id
group by all"""

_WEEKLY = f"""
select ds.schedule_id, ds.doctor_id, ds.slot_id, ds.day_of_week, c.day "date", dayname(c.day) day_name,
  ts.start_time, ts.end_time, b.slot_id is null is_available,
  case when b.slot_id is null then 'Available' else 'Booked' end slot_status
from (select {TODAY} + cast(n_nationkey as int) as day from nation where n_nationkey < 7) c
join doctor_schedules ds on ds.day_of_week = dayofweek(c.day) and ds.is_active
join {SLOTS} ts on ts.slot_id = ds.slot_id
left join {TAKEN} b on b.doctor_id = ds.doctor_id and b.slot_id = ds.slot_id and b.appointment_date = c.day"""
ORACLE["weekly_availability"] = _WEEKLY
ORACLE["weekly_availability_days"] = f"""
select d.doctor_id, d.doctor_name, d.specialization_name, d.consultation_fee, x."date", x.day_of_week, x.day_name,
  count(*) filter (where x.is_available) available_slots, count(*) total_slots
from ({_WEEKLY}) x join {DOCTORS} d on d.doctor_id = x.doctor_id group by all"""
ORACLE["slot_check"] = f"""
select r.request_id, r.doctor_id, r.slot_id, r.appointment_date, x.reason = 'Available' is_available, x.reason,
  case when r.appointment_date between {TODAY} and {TODAY} + 7 then ts.start_time end start_time,
  case when r.appointment_date between {TODAY} and {TODAY} + 7 then ts.end_time end end_time
from booking_requests r
left join doctor_schedules ds on ds.doctor_id = r.doctor_id and ds.slot_id = r.slot_id
  and ds.day_of_week = dayofweek(r.appointment_date)
left join {SLOTS} ts on ts.slot_id = ds.slot_id
join lateral (select case
  when r.appointment_date < {TODAY} then 'Cannot book appointments in the past'
  when r.appointment_date > {TODAY} + 7 then 'Appointments can only be booked up to 7 days in advance'
  when ds.schedule_id is null then 'Slot not in doctor''s schedule for this day of week'
  when not ds.is_active then 'Schedule inactive'
  when (r.doctor_id, r.appointment_date, r.slot_id) in (select (doctor_id, appointment_date, slot_id) from {TAKEN})
    then 'Already booked' else 'Available' end reason) x on true"""

# --- clinical --------------------------------------------------------------

ORACLE["appointment_form_detail"] = f"""
select f.*, p.patient_name, d.doctor_name
from appointment_forms f join {PATIENTS} p using (patient_id) join appointments a using (appointment_id)
join {DOCTORS} d on d.doctor_id = a.doctor_id"""
ORACLE["patient_forms"] = f"""
select f.*, a.appointment_date, d.doctor_name, d.specialization_name
from appointment_forms f join appointments a using (appointment_id) join {DOCTORS} d on d.doctor_id = a.doctor_id"""
ORACLE["consultation_detail"] = f"""
select c.*, p.patient_name, d.doctor_name, a.appointment_date
from consultations c join {PATIENTS} p on p.patient_id = c.patient_id join {DOCTORS} d on d.doctor_id = c.doctor_id
join appointments a on a.appointment_id = c.appointment_id"""
ORACLE["consultation_exists"] = """
select a.appointment_id, c.consultation_id is not null "exists", c.consultation_id, c.diagnosis, c.consultation_date
from appointments a left join consultations c using (appointment_id)"""
ORACLE["patient_consultations"] = f"""
select c.consultation_id, c.appointment_id, c.patient_id, c.doctor_id, c.blood_pressure, c.temperature,
  c.oxygen_saturation, c.diagnosis, strftime(c.consultation_date, '%Y-%m-%d %H:%M:%S') consultation_date,
  strftime(a.appointment_date, '%Y-%m-%d') appointment_date, ts.start_time, ts.end_time, d.doctor_name,
  d.specialization_name
from consultations c join appointments a on a.appointment_id = c.appointment_id
join {DOCTORS} d on d.doctor_id = c.doctor_id left join {SLOTS} ts on ts.slot_id = a.slot_id"""
ORACLE["doctor_consultations"] = f"""
select c.*, p.patient_name, p.age, p.gender, p.blood_group, a.appointment_date
from consultations c join {PATIENTS} p on p.patient_id = c.patient_id
join appointments a on a.appointment_id = c.appointment_id"""
ORACLE["consultation_medicines"] = "select * from prescribed_medicines"
ORACLE["patient_prescriptions"] = """
select m.medicine_id, m.consultation_id, c.patient_id, m.medicine_name, m.dosage, m.frequency, m.duration,
  strftime(c.consultation_date, '%Y-%m-%d') consultation_date, concat(d.first_name, ' ', d.last_name) doctor_name
from prescribed_medicines m join consultations c on c.consultation_id = m.consultation_id
join doctors d on d.doctor_id = c.doctor_id"""
ORACLE["consultation_actions"] = f"""
select ca.*, {ACTION_X}, k.action_name from consultation_actions ca join action_types k using (action_type_id)"""
ORACLE["appointment_patient_card"] = """
select a.appointment_id, coalesce(nullif(concat(p.first_name, ' ', p.last_name), ''), 'Unknown') as name,
  coalesce(cast(nullif(p.age, 0) as varchar), 'N/A') age, coalesce(nullif(p.gender, ''), 'Not specified') gender,
  coalesce(nullif(f.symptoms, ''), 'No symptoms recorded') symptoms,
  coalesce(nullif(f.medical_history, ''), 'No medical history recorded') allergies
from appointments a join patients p on p.patient_id = a.patient_id
left join appointment_forms f on f.appointment_id = a.appointment_id"""
ORACLE["doctor_scheduled_appointments"] = f"""
select a.appointment_id, a.doctor_id, a.appointment_date, a.slot_id, a.status_id, a.created_at, ts.start_time,
  ts.end_time, p.patient_id, p.first_name patient_first_name, p.last_name patient_last_name, p.phone_no,
  p.patient_login_id, s.status_name
from appointments a join patients p on p.patient_id = a.patient_id left join {SLOTS} ts on ts.slot_id = a.slot_id
left join appointment_statuses s on s.status_id = a.status_id
where a.status_id = 1"""
ORACLE["patient_upcoming_appointments"] = f"""
select a.appointment_id, a.appointment_date, a.patient_id, a.doctor_id, a.slot_id, ts.start_time, ts.end_time,
  concat(d.first_name, ' ', d.last_name) doctor_name, sp.specialization_name, d.consultation_fee, s.status_name
from appointments a left join doctors d on d.doctor_id = a.doctor_id left join {SLOTS} ts on ts.slot_id = a.slot_id
left join specializations sp on sp.specialization_id = d.specialization_id
left join appointment_statuses s on s.status_id = a.status_id
where a.appointment_date >= date '2001-06-01' and a.status_id <> 3"""
_PAIRS = """
select c.doctor_id, p.patient_id, p.patient_login_id, p.first_name, p.last_name, p.gender, p.age, p.blood_group,
  p.phone_no, count(c.consultation_id) total_consultations, max(c.consultation_date) last_consultation_date,
  max(c.diagnosis) latest_diagnosis,
  (max({{'at': c.consultation_date, 'id': c.consultation_id, 'd': c.diagnosis}}))['d'] latest_diagnosis_exact
from patients p join consultations c on c.patient_id = p.patient_id {where} group by all"""
ORACLE["doctor_patients_summary"] = _PAIRS.format(where="")
ORACLE["doctor_patients_summary_female"] = _PAIRS.format(where="where p.gender = 'Female'")
ORACLE["medical_report"] = f"""
select c.consultation_id, a.appointment_id, p.patient_login_id, p.patient_name,
  concat('Dr. ', d.doctor_name) doctor_name, d.specialization_name,
  strftime(a.appointment_date, '%d/%m/%Y') appointment_date,
  strftime(c.consultation_date, '%d/%m/%Y %H:%M') consultation_date,
  coalesce(c.diagnosis, 'Diagnosis pending') diagnosis, coalesce(c.blood_pressure, 'N/A') blood_pressure,
  coalesce(cast(c.temperature as varchar) || '°F', 'N/A') temperature,
  coalesce(cast(c.oxygen_saturation as varchar) || '%', 'N/A') oxygen_saturation
from consultations c join appointments a on a.appointment_id = c.appointment_id
join {PATIENTS} p on p.patient_id = c.patient_id join {DOCTORS} d on d.doctor_id = c.doctor_id
where a.status_id = 2"""

# --- wards -----------------------------------------------------------------

ORACLE["admission_recommended"] = """
select ca.action_id, ca.consultation_id, ca.notes, ca.created_at, ca.status, k.action_name, c.patient_id,
  p.first_name patient_first_name, p.last_name patient_last_name, p.patient_login_id, p.gender patient_gender,
  p.age patient_age, p.blood_group, c.doctor_id, d.first_name doctor_first_name, d.last_name doctor_last_name,
  d.doctor_login_id, d.specialization_id doctor_specialization_id, s.specialization_name doctor_specialization_name,
  d.consultation_fee, c.appointment_id, c.diagnosis,
  strftime(c.consultation_date, '%Y-%m-%d %H:%M:%S') consultation_date
from consultation_actions ca join action_types k on k.action_type_id = ca.action_type_id
join consultations c on c.consultation_id = ca.consultation_id join patients p on p.patient_id = c.patient_id
join doctors d on d.doctor_id = c.doctor_id join specializations s on s.specialization_id = d.specialization_id
where k.action_name = 'Admit' and ca.status = 'Pending'
  and not exists (select 1 from admissions x where x.consultation_id = c.consultation_id and x.is_active)"""
_BEDS = """
select b.bed_id, b.bed_code, b.room_id, b.bed_number, b.is_occupied, r.room_number, k.type_name, k.per_day_charges,
  r.floor_number{more}
from beds b join rooms r on r.room_id = b.room_id join room_types k on k.room_type_id = r.room_type_id"""
ORACLE["beds"] = (
    _BEDS.format(
        more=", p.first_name patient_first_name, p.last_name patient_last_name, p.gender patient_gender"
    )
    + """
left join admissions a on a.bed_id = b.bed_id and a.is_active left join patients p on p.patient_id = a.patient_id"""
)
ORACLE["beds_available_filtered"] = (
    _BEDS.format(more="")
    + """
where not b.is_occupied and (k.type_name like '%-F%' or (k.type_name not like '%-M%' and k.type_name not like '%-F%'))
  and (k.type_name like '%CARD%' or k.type_name like '%GENERAL%')"""
)
ORACLE["beds_available_male"] = (
    _BEDS.format(more="")
    + """
where not b.is_occupied and (k.type_name like '%-M%' or (k.type_name not like '%-M%' and k.type_name not like '%-F%'))"""
)
ORACLE["beds_available_department"] = (
    _BEDS.format(more="") + " where not b.is_occupied and k.type_name like '%PED%'"
)
ORACLE["rooms_occupancy"] = f"""
select r.room_id, r.room_number, r.room_type_id, k.type_name, {KIND_X}, k.per_day_charges, r.floor_number,
  r.is_occupied, count(b.bed_id) total_beds,
  cast(sum(case when b.is_occupied then 1 else 0 end) as bigint) occupied_beds
from rooms r join room_types k on k.room_type_id = r.room_type_id left join beds b on b.room_id = r.room_id
group by all"""
ORACLE["rooms_department"] = f"""
select r.room_id, r.room_number, r.room_type_id, k.type_name, {KIND_X}, k.per_day_charges, r.floor_number,
  r.is_occupied, case when contains(k.type_name, 'CARD') then 'Cardiology'
    when contains(k.type_name, 'ORTHO') then 'Orthopedics' when contains(k.type_name, 'NEURO') then 'Neurology'
    when contains(k.type_name, 'DERMA') then 'Dermatology' when contains(k.type_name, 'PED') then 'Pediatrics'
    else 'General' end department_name
from rooms r join room_types k using (room_type_id)"""
ORACLE["room_types"] = f"""
select *, {KIND_X}, case right(type_name, 2) when '-M' then 'Male' when '-F' then 'Female' else 'Mixed' end
  gender_category from long_room_types"""
ORACLE["room_charges"] = "select room_type_id, per_day_charges daily_charge from long_room_types"
ORACLE["rooms_available_by_bed"] = """
select r.*, k.type_name, k.per_day_charges from rooms r join room_types k using (room_type_id)
where not r.is_occupied and exists (select 1 from beds b where b.room_id = r.room_id and not b.is_occupied)"""
ORACLE["rooms_available_by_admission"] = """
select r.*, k.type_name, k.per_day_charges from rooms r join room_types k using (room_type_id)
where r.room_id not in (select initial_room_id from admissions where is_active)"""
_STAY = """
from admissions a join patients p on p.patient_id = a.patient_id join doctors d on d.doctor_id = a.doctor_id
join specializations s on s.specialization_id = d.specialization_id
join rooms r on r.room_id = a.initial_room_id join room_types k on k.room_type_id = r.room_type_id
join receptionists n on n.receptionist_id = a.assigned_by_receptionist_id"""
_STAY_NAMES = """concat(p.first_name, ' ', p.last_name) patient_name, p.age, p.gender, p.blood_group,
  concat(d.first_name, ' ', d.last_name) doctor_name, r.room_number, k.type_name room_type,
  concat(n.first_name, ' ', n.last_name) receptionist_name"""
_DAYS = f"cast(date_diff('day', a.admission_date, {AS_OF}) as int) days_admitted"
ORACLE["active_admissions"] = f"""
select a.*, {_STAY_NAMES}, p.phone_no, d.specialization_id, k.per_day_charges, b.bed_number, b.bed_code,
  {_DAYS} {_STAY} join beds b on b.bed_id = a.bed_id where a.is_active"""
ORACLE["active_admissions_any_bed"] = f"select a.*, {_STAY_NAMES}, {_DAYS} {_STAY} where a.is_active"
ORACLE["active_admissions_detailed"] = f"""
select a.*, {_STAY_NAMES}, p.phone_no, d.specialization_id, k.per_day_charges, b.bed_number, b.bed_code,
  s.specialization_name, {_DAYS} {_STAY} join beds b on b.bed_id = a.bed_id where a.is_active"""
ORACLE["active_admissions_report"] = f"""
select a.admission_id, p.patient_login_id, p.patient_name, concat('Dr. ', d.doctor_name) doctor_name,
  strftime(a.admission_date, '%Y-%m-%d') admission_date
from admissions a join {PATIENTS} p using (patient_id) join {DOCTORS} d using (doctor_id) where a.is_active"""
ORACLE["active_admissions_total"] = "select count(*) total from admissions where is_active"
ORACLE["admission_detail"] = f"""
select a.*, {_STAY_NAMES}, p.phone_no, k.per_day_charges,
  cast(date_diff('day', a.admission_date, coalesce(a.discharge_date, {AS_OF})) as int) total_days {_STAY}"""
ORACLE["action_admission_status"] = f"""
select ca.action_id, ca.status, ca.consultation_id, c.patient_id, c.doctor_id, p.patient_name, d.doctor_name,
  d.specialization_name, x.n existing_admission, x.n > 0 is_admitted
from consultation_actions ca join consultations c on c.consultation_id = ca.consultation_id
join {PATIENTS} p on p.patient_id = c.patient_id join {DOCTORS} d on d.doctor_id = c.doctor_id
join lateral (select count(*) n from admissions a where a.consultation_id = ca.consultation_id and a.is_active) x
  on true"""
ORACLE["bed_availability"] = "select count(*) available_beds from beds where not is_occupied"

# --- visits ----------------------------------------------------------------

ORACLE["doctor_admitted_patients"] = f"""
select a.admission_id, a.patient_id, a.doctor_id, a.admission_date, a.admission_notes, a.is_active, p.first_name,
  p.last_name, p.age, p.gender, p.blood_group, p.phone_no, p.patient_login_id, r.room_number, b.bed_number,
  b.bed_code, c.consultation_date, concat(d.first_name, ' ', d.last_name) doctor_name, {_DAYS},
  (select v.condition_status from admitted_patient_visits v where v.admission_id = a.admission_id
    order by v.visit_datetime desc nulls last, v.visit_id desc limit 1) last_condition_status
from admissions a join patients p on p.patient_id = a.patient_id join doctors d on d.doctor_id = a.doctor_id
left join consultations c on c.consultation_id = a.consultation_id left join rooms r on r.room_id = a.initial_room_id
left join beds b on b.bed_id = a.bed_id where a.is_active and a.discharge_date is null"""
ORACLE["admission_visits"] = f"""
select v.*, {VISIT_X}, p.first_name patient_first_name, p.last_name patient_last_name,
  concat(d.first_name, ' ', d.last_name) doctor_name, strftime(v.visit_datetime, '%Y-%m-%d %H:%M') formatted_visit_date,
  strftime(v.discharge_recommended_date, '%Y-%m-%d') formatted_discharge_date
from admitted_patient_visits v join patients p on p.patient_id = v.patient_id join doctors d on d.doctor_id = v.doctor_id"""
ORACLE["doctor_recent_visits"] = """
select v.visit_id, v.admission_id, v.patient_id, v.doctor_id, v.blood_pressure, v.temperature, v.oxygen_saturation,
  v.pulse_rate, v.condition_status, v.ready_for_discharge, v.visit_datetime,
  concat(p.first_name, ' ', p.last_name) patient_name, p.gender, p.age, r.room_number, b.bed_number,
  strftime(v.visit_datetime, '%b %d, %Y %H:%M') formatted_date
from admitted_patient_visits v join patients p on p.patient_id = v.patient_id
join admissions a on a.admission_id = v.admission_id left join rooms r on r.room_id = a.initial_room_id
left join beds b on b.bed_id = a.bed_id
qualify row_number() over (partition by v.doctor_id order by v.visit_datetime desc nulls last, v.visit_id desc) <= 10"""
ORACLE["doctor_visits_summary"] = f"""
select doctor_id, count(*) total_visits, count(*) filter (where condition_status = 'Stable') stable_count,
  count(*) filter (where condition_status = 'Improving') improving_count,
  count(*) filter (where condition_status = 'Critical') critical_count,
  count(*) filter (where condition_status = 'Deteriorating') deteriorating_count,
  count(*) filter (where ready_for_discharge) ready_for_discharge_count,
  cast(sum(cast(temperature as decimal(18,4))) as double) / count(temperature) avg_temperature,
  cast(sum(cast(oxygen_saturation as decimal(18,4))) as double) / count(oxygen_saturation) avg_oxygen_saturation,
  cast(sum(cast(pulse_rate as decimal(18,4))) as double) / count(pulse_rate) avg_pulse_rate
from admitted_patient_visits where visit_datetime >= {AS_OF} - interval 30 day group by doctor_id"""
ORACLE["doctor_visits_trend"] = f"""
select doctor_id, cast(visit_datetime as date) visit_date, count(*) visit_count
from admitted_patient_visits where visit_datetime >= {AS_OF} - interval 30 day group by all"""
ORACLE["patient_admitted_visits"] = f"""
select v.*, {VISIT_X}, p.patient_name, p.age, p.gender, d.doctor_name, d.specialization_id, d.specialization_name,
  a.admission_date, r.room_number, b.bed_number,
  strftime(v.visit_datetime, '%d %b %Y, %I:%M %p') formatted_visit_date,
  strftime(v.visit_datetime, '%Y-%m-%d') visit_date_only, strftime(v.visit_datetime, '%H:%M') visit_time_only,
  strftime(v.discharge_recommended_date, '%d %b %Y') formatted_discharge_recommended_date,
  cast(date_diff('day', a.admission_date, v.visit_datetime) as int) days_since_admission
from admitted_patient_visits v join {PATIENTS} p on p.patient_id = v.patient_id
join {DOCTORS} d on d.doctor_id = v.doctor_id join admissions a on a.admission_id = v.admission_id
left join rooms r on r.room_id = a.initial_room_id left join beds b on b.bed_id = a.bed_id"""
ORACLE["patient_visits_by_date"] = """
select patient_id, strftime(visit_datetime, '%Y-%m-%d') visit_date_only, count(*) visits,
  min(visit_datetime) first_visit, max(visit_datetime) last_visit from admitted_patient_visits group by all"""
ORACLE["patient_visits_summary"] = """
select patient_id, count(*) total_visits, count(*) filter (where condition_status = 'Stable') stable_visits,
  count(*) filter (where condition_status = 'Improving') improving_visits,
  count(*) filter (where condition_status = 'Critical') critical_visits,
  count(*) filter (where condition_status = 'Deteriorating') deteriorating_visits,
  count(*) filter (where ready_for_discharge) ready_for_discharge_count,
  cast(sum(cast(temperature as decimal(18,4))) as double) / count(temperature) avg_temperature, cast(sum(cast(oxygen_saturation as decimal(18,4))) as double) / count(oxygen_saturation) avg_oxygen,
  cast(sum(cast(pulse_rate as decimal(18,4))) as double) / count(pulse_rate) avg_pulse, min(visit_datetime) first_visit_date,
  max(visit_datetime) last_visit_date, count(distinct doctor_id) unique_doctors_count
from admitted_patient_visits group by patient_id"""
ORACLE["patient_visit_doctors"] = f"""
select v.patient_id, v.doctor_id, d.doctor_name, d.specialization_name, count(v.visit_id) visits_by_doctor
from admitted_patient_visits v join {DOCTORS} d on d.doctor_id = v.doctor_id group by all"""
ORACLE["ready_for_discharge"] = f"""
select a.admission_id, a.patient_id, a.doctor_id, a.bed_id, a.initial_room_id, a.admission_date, a.admission_notes,
  p.first_name patient_first_name, p.last_name patient_last_name, p.patient_login_id, p.age, p.gender, p.blood_group,
  p.phone_no, d.first_name doctor_first_name, d.last_name doctor_last_name, d.doctor_login_id, d.specialization_id,
  s.specialization_name, r.room_number, r.room_type_id, k.type_name room_type, k.per_day_charges, b.bed_number,
  b.bed_code, v.visit_id, v.ready_for_discharge, v.discharge_recommended_date, v.condition_status,
  v.visit_datetime last_visit_date, cast(null as varchar) treatment_given, cast(null as varchar) doctor_notes, {_DAYS}
{_STAY.replace("join receptionists n on n.receptionist_id = a.assigned_by_receptionist_id", "")}
join beds b on b.bed_id = a.bed_id
join (select admission_id, max(visit_datetime) latest from admitted_patient_visits where ready_for_discharge
  group by admission_id) m on m.admission_id = a.admission_id
join admitted_patient_visits v on v.admission_id = a.admission_id and v.visit_datetime = m.latest
where a.is_active and v.ready_for_discharge
  and not exists (select 1 from discharges x where x.admission_id = a.admission_id)"""

# --- billing ---------------------------------------------------------------

ORACLE["discharge_list"] = f"""
select x.*, {DISCHARGE_X}, p.patient_name, concat(d.first_name, ' ', d.last_name) doctor_name,
  concat(n.first_name, ' ', n.last_name) receptionist_name
from discharges x join {PATIENTS} p on p.patient_id = x.patient_id join doctors d on d.doctor_id = x.doctor_id
join receptionists n on n.receptionist_id = x.processed_by_receptionist_id"""
ORACLE["discharge_list_unpaid"] = ORACLE["discharge_list"] + " where x.payment_status = 'Unpaid'"
ORACLE["doctor_discharged_patients"] = f"""
select x.discharge_id, x.admission_id, x.patient_id, x.doctor_id, x.discharge_date, x.total_days, x.total_amount,
  x.payment_status, x.amount_paid, x.final_diagnosis, cast(null as varchar) discharge_summary, x.follow_up_required,
  cast(null as date) follow_up_date, p.patient_name, p.age, p.gender, p.blood_group, p.phone_no, r.room_number,
  d.doctor_name, d.specialization_id, d.specialization_name,
  cast(date_diff('day', a.admission_date, x.discharge_date) as int) hospital_days,
  strftime(x.discharge_date, '%Y-%m-%d') formatted_discharge_date,
  strftime(a.admission_date, '%Y-%m-%d') formatted_admission_date
from discharges x join {PATIENTS} p on p.patient_id = x.patient_id join {DOCTORS} d on d.doctor_id = x.doctor_id
join admissions a on a.admission_id = x.admission_id left join rooms r on r.room_id = a.initial_room_id
where x.discharge_date >= date '1997-01-01' and x.discharge_date <= date '2000-12-31'
qualify row_number() over (partition by x.doctor_id order by x.discharge_date desc, x.discharge_id desc) <= 50"""
ORACLE["discharge_bundle"] = f"""
select x.*, {DISCHARGE_X}, p.patient_name, p.age, p.gender, p.blood_group, p.phone_no, d.doctor_name,
  d.specialization_name, concat(n.first_name, ' ', n.last_name) receptionist_name,
  strftime(x.discharge_date, '%d %b %Y %H:%M') formatted_discharge_date, a.admission_date,
  a.discharge_date admission_discharge_date, a.admission_notes, a.initial_room_id, a.bed_id, a.consultation_id,
  a.action_id, a.is_active, a.assigned_by_receptionist_id, r.room_number, b.bed_number, b.bed_code,
  k.type_name room_type, k.per_day_charges, strftime(a.admission_date, '%d %b %Y %H:%M') formatted_admission_date
from discharges x join {PATIENTS} p on p.patient_id = x.patient_id join {DOCTORS} d on d.doctor_id = x.doctor_id
join receptionists n on n.receptionist_id = x.processed_by_receptionist_id
left join admissions a on a.admission_id = x.admission_id left join rooms r on r.room_id = a.initial_room_id
left join beds b on b.bed_id = a.bed_id left join room_types k on k.room_type_id = r.room_type_id"""
ORACLE["discharge_bundle_visits"] = f"""
select x.discharge_id, v.*, {VISIT_X}, strftime(v.visit_datetime, '%d %b %Y %H:%M') formatted_visit_date,
  strftime(v.discharge_recommended_date, '%d %b %Y') formatted_recommended_discharge_date
from discharges x join admitted_patient_visits v on v.admission_id = x.admission_id"""
_STATS = f"""
select doctor_id, count(*) total_discharges, count(*) filter (where follow_up_required) follow_up_required,
  cast(sum(total_amount) as decimal(18,2)) total_revenue, cast(sum(cast(total_amount as decimal(18,4))) as double) / count(total_amount) average_bill,
  cast(sum(cast(total_days as decimal(18,4))) as double) / count(total_days) avg_hospital_stay,
  count(*) filter (where payment_status = 'Paid') paid_count,
  count(*) filter (where payment_status = 'Unpaid') unpaid_count,
  count(*) filter (where payment_status = 'Partial') partial_count,
  cast(sum(amount_paid) as decimal(18,2)) total_paid,
  cast(sum(total_amount - amount_paid) as decimal(18,2)) total_pending
from discharges where discharge_date >= {AS_OF} - interval {{period}} group by doctor_id"""
ORACLE["doctor_discharge_stats"] = _STATS.format(period="1 year")
ORACLE["doctor_discharge_stats_month"] = _STATS.format(period="1 month")
ORACLE["discharge_search"] = f"""
select x.discharge_id, x.admission_id, x.patient_id, x.doctor_id, x.discharge_date, x.total_amount, x.payment_status,
  p.patient_name, p.phone_no, d.doctor_name, d.specialization_name
from discharges x join {PATIENTS} p on p.patient_id = x.patient_id join {DOCTORS} d on d.doctor_id = x.doctor_id
where p.first_name ilike '%ro%' or p.last_name ilike '%ro%' or p.phone_no ilike '%ro%'
  or p.patient_login_id ilike '%ro%' or d.first_name ilike '%ro%' or d.last_name ilike '%ro%'
  or d.specialization_name ilike '%ro%'"""
ORACLE["recent_discharges"] = f"""
select x.discharge_id, p.patient_login_id, p.patient_name, strftime(x.discharge_date, '%Y-%m-%d') discharge_date,
  x.total_days, x.total_amount, x.payment_status, x.amount_paid, x.room_charges, x.medical_charges,
  x.doctor_visit_charges, x.lab_charges, x.other_charges, concat('Dr. ', d.doctor_name) doctor_name,
  d.specialization_name, strftime(a.admission_date, '%Y-%m-%d') admission_date, n.receptionist_login_id processed_by,
  x.final_diagnosis, x.follow_up_required, cast(null as varchar) follow_up_date,
  cast(x.total_amount - x.amount_paid as decimal(18,2)) balance_due
from discharges x join {PATIENTS} p on p.patient_id = x.patient_id join admissions a on a.admission_id = x.admission_id
join {DOCTORS} d on d.doctor_id = x.doctor_id join receptionists n on n.receptionist_id = x.processed_by_receptionist_id
order by x.discharge_date desc nulls last, x.discharge_id desc limit 30"""

# --- reports ---------------------------------------------------------------

_DAILY_PATIENTS = f"""
select p.patient_id, p.patient_login_id, p.first_name || ' ' || p.last_name patient_name, p.age, p.gender,
  p.blood_group, p.phone_no, p.created_at registration_date, count(distinct a.appointment_id) total_appointments,
  count(distinct case when a.appointment_date = {DAY} then a.appointment_id end) appointments_today,
  count(distinct s.admission_id) total_admissions,
  count(distinct case when s.admission_date >= {DAY} then s.admission_id end) admissions_today,
  count(distinct case when cast(s.admission_date as date) = {DAY} then s.admission_id end) admissions_on_day
from patients p left join appointments a on a.patient_id = p.patient_id
left join admissions s on s.patient_id = p.patient_id
where cast(p.created_at as date) = {DAY} or a.appointment_date = {DAY} or cast(s.admission_date as date) = {DAY}
group by all"""
ORACLE["daily_patients"] = _DAILY_PATIENTS
ORACLE["daily_patients_summary"] = f"""
select count(*) total_patients, count(*) filter (where cast(registration_date as date) = {DAY}) new_patients,
  cast(sum(appointments_today) as bigint) appointments_today, cast(sum(admissions_today) as bigint) admissions_today,
  {DAY} "date" from ({_DAILY_PATIENTS})"""
_DAILY_DOCTORS = f"""
select d.doctor_id, d.doctor_login_id, d.first_name || ' ' || d.last_name doctor_name, s.specialization_name,
  d.consultation_fee, d.phone_no, d.experience_years, count(distinct a.appointment_id) total_appointments_today,
  count(distinct c.consultation_id) consultations_today, count(distinct v.visit_id) patient_visits_today,
  cast(sum(case when a.status_id = 2 then d.consultation_fee else 0 end) as decimal(18,2)) revenue_today,
  cast(max(d.consultation_fee) * count(distinct case when a.status_id = 2 then a.appointment_id end) as decimal(18,2))
    revenue_today_exact
from doctors d join specializations s on s.specialization_id = d.specialization_id
left join appointments a on a.doctor_id = d.doctor_id and a.appointment_date = {DAY} and a.status_id <> 3
left join consultations c on c.appointment_id = a.appointment_id and cast(c.consultation_date as date) = {DAY}
left join admitted_patient_visits v on v.doctor_id = d.doctor_id and cast(v.visit_datetime as date) = {DAY}
group by all"""
ORACLE["daily_doctors"] = _DAILY_DOCTORS
ORACLE["daily_doctors_summary"] = f"""
select count(*) total_doctors, cast(sum(total_appointments_today) as bigint) total_appointments,
  cast(sum(revenue_today) as decimal(18,2)) total_revenue, {DAY} "date" from ({_DAILY_DOCTORS})"""
_PATIENTS_RANGE = f"""
select p.patient_id, p.patient_login_id, p.first_name || ' ' || p.last_name patient_name, p.age, p.gender,
  p.blood_group, p.phone_no, p.created_at registration_date, count(distinct a.appointment_id) total_appointments,
  count(distinct c.consultation_id) total_consultations, count(distinct s.admission_id) total_admissions,
  count(distinct x.discharge_id) total_discharges, min(a.appointment_date) first_appointment_date,
  max(a.appointment_date) last_appointment_date,
  cast(sum(case when a.status_id = 2 then d.consultation_fee else 0 end) as decimal(18,2)) total_spent,
  cast(coalesce(list_sum(list_transform(
    list(distinct {{'a': a.appointment_id, 'fee': d.consultation_fee}}) filter (where a.status_id = 2), lambda z: z.fee)), 0)
    as decimal(18,2)) total_spent_exact
from patients p left join appointments a on a.patient_id = p.patient_id
left join consultations c on c.appointment_id = a.appointment_id
left join admissions s on s.patient_id = p.patient_id left join discharges x on x.admission_id = s.admission_id
left join doctors d on d.doctor_id = a.doctor_id
where p.created_at between {START} and {END_SECOND} or a.appointment_date between {START} and {END_SECOND}
  or s.admission_date between {START} and {END_SECOND}
group by all"""
ORACLE["patients_range"] = _PATIENTS_RANGE
ORACLE["patients_range_summary"] = f"""
select count(*) total_patients, count(*) filter (where registration_date between {START} and {END}) new_registrations,
  cast(sum(total_appointments) as bigint) total_appointments, cast(sum(total_admissions) as bigint) total_admissions,
  cast(sum(total_spent) as decimal(18,2)) total_revenue, '1999-01-01 to 1999-03-31' period from ({_PATIENTS_RANGE})"""
_DOCTORS_RANGE = f"""
select d.doctor_id, d.doctor_login_id, d.first_name || ' ' || d.last_name doctor_name, s.specialization_name,
  d.consultation_fee, d.experience_years, d.registration_number, count(distinct a.appointment_id) total_appointments,
  count(distinct a.appointment_id) filter (where a.status_id = 2) completed_appointments,
  count(distinct a.appointment_id) filter (where a.status_id = 1) scheduled_appointments,
  count(distinct a.appointment_id) filter (where a.status_id = 3) cancelled_appointments,
  count(distinct c.consultation_id) total_consultations, count(distinct v.visit_id) patient_visits,
  count(distinct h.admission_id) admissions_recommended,
  cast(sum(case when a.status_id = 2 then d.consultation_fee else 0 end) as decimal(18,2)) total_revenue,
  cast(max(d.consultation_fee) * count(distinct a.appointment_id) filter (where a.status_id = 2) as decimal(18,2))
    total_revenue_exact,
  round(avg(case when a.status_id = 2 then 1.0 else 0.0 end) * 100, 4) completion_rate
from doctors d join specializations s on s.specialization_id = d.specialization_id
left join appointments a on a.doctor_id = d.doctor_id and a.appointment_date between {START} and {END_SECOND}
left join consultations c on c.appointment_id = a.appointment_id
left join admitted_patient_visits v on v.doctor_id = d.doctor_id and v.visit_datetime between {START} and {END_SECOND}
left join admissions h on h.doctor_id = d.doctor_id and h.admission_date between {START} and {END_SECOND}
group by all"""
ORACLE["doctors_range"] = _DOCTORS_RANGE
ORACLE["busiest_doctors"] = f"""
select doctor_id, doctor_name, experience_years, total_appointments, total_revenue from ({_DOCTORS_RANGE})
order by total_appointments desc, experience_years desc nulls last, doctor_id limit 10"""
ORACLE["patient_visits_nested"] = """
select patient_id, visit_date_only, cast((k - 1) // 2 as int) page, cast(count(*) as int) in_page,
  string_agg(concat(visit_id, '@', clock), ', ' order by k) visits
from (select *, row_number() over (partition by patient_id, visit_date_only order by visit_datetime desc, visit_id desc) k
  from (select *, strftime(visit_datetime, '%Y-%m-%d') visit_date_only, strftime(visit_datetime, '%H:%M') clock from admitted_patient_visits))
group by all"""
ORACLE["beds_of_rooms"] = """
select cast((room_id - 1) * 8 + n as bigint) bed_id, concat(room_number, '-B', n) bed_code, room_id, cast(n as int) bed_number, false is_occupied
from rooms join room_types using (room_type_id),
  unnest(generate_series(1, case when type_name like 'GWARD%' then 8 when type_name = 'PRIVATE ROOM' then 1 else 0 end)) u(n)"""
ORACLE["seeded_slots_in_use"] = """
select cast(k as bigint) slot_id, cast(360 + 30 * (k - 1) as int) start_min, cast(390 + 30 * (k - 1) as int) end_min, coalesce(n, 0) appointments
from generate_series(1, 24) u(k) left join (select slot_id, count(*) n from appointments group by slot_id) a on a.slot_id = k"""
ORACLE["doctors_range_summary"] = f"""
select count(*) total_doctors, cast(sum(total_appointments) as bigint) total_appointments,
  cast(sum(total_revenue) as decimal(18,2)) total_revenue, cast(sum(cast(completion_rate as decimal(18,4))) as double) / count(*) average_completion_rate,
  '1999-01-01 to 1999-03-31' period from ({_DOCTORS_RANGE})"""


def _four(first: str, last: str) -> str:
    return f"""
  (select count(*) from patients where cast(created_at as date) between {first} and {last}) new_patients,
  (select count(*) from appointments where appointment_date between {first} and {last}) appointments,
  (select count(*) from consultations where cast(consultation_date as date) between {first} and {last}) consultations,
  (select count(*) from admissions where cast(admission_date as date) between {first} and {last}) admissions"""


ORACLE["daily_summary"] = f'select {DAY} "date", {_four(DAY, DAY)}'
ORACLE["range_summary"] = f"select {TODAY} - 30 start_date, {TODAY} end_date, {_four(f'{TODAY} - 30', TODAY)}"
ORACLE["today_appointments"] = f"""
select a.appointment_id, p.patient_login_id, p.patient_name, concat('Dr. ', d.doctor_name) doctor_name, s.status_name
from appointments a join {PATIENTS} p on p.patient_id = a.patient_id join {DOCTORS} d on d.doctor_id = a.doctor_id
join appointment_statuses s on s.status_id = a.status_id where a.appointment_date = {DAY}"""
ORACLE["today_appointments_total"] = f"select count(*) total from appointments where appointment_date = {DAY}"


#: A dataset called with a filter gives the rows of the whole one that meet a condition.
FILTERED = {
    "schedules_of_doctor_day": ("schedules", "doctor_id = 3 and day_of_week = 2"),
    "weekly_availability_of_doctor": ("weekly_availability", "doctor_id = 3"),
    "patient_forms_of_patient": ("patient_forms", "patient_id = 7"),
    "patient_consultations_of_patient": ("patient_consultations", "patient_id = 7"),
    "doctor_consultations_of_doctor": ("doctor_consultations", "doctor_id = 3"),
    "doctor_scheduled_appointments_of_doctor": ("doctor_scheduled_appointments", "doctor_id = 3"),
    "doctor_patients_summary_of_doctor": ("doctor_patients_summary", "doctor_id = 3"),
    "doctor_admitted_patients_of_doctor": ("doctor_admitted_patients", "doctor_id = 0"),
    "doctor_recent_visits_of_doctor": ("doctor_recent_visits", "doctor_id = 4"),
    "patient_admitted_visits_of_patient": ("patient_admitted_visits", "patient_id = 4"),
    "admission_visits_of_admission": ("admission_visits", "admission_id = 4"),
    "discharge_list_of_patient": ("discharge_list", "patient_id = 4"),
    "doctor_discharged_patients_of_doctor": ("doctor_discharged_patients", "doctor_id = 4"),
}
ORACLE.update({name: f"select * from ({ORACLE[base]}) where {condition}" for name, (base, condition) in FILTERED.items()})
for _list, _key, _base in (
    ("doctor_recent_visits", "visit", ORACLE["doctor_recent_visits"]),
    ("doctor_discharged_patients", "discharge", ORACLE["doctor_discharged_patients"]),
):
    _date = f"{_key}_datetime" if _key == "visit" else f"{_key}_date"
    ORACLE[f"{_list}_in_order"] = f"""
    select *, cast(row_number() over (partition by doctor_id order by {_date} desc nulls last, {_key}_id desc nulls last) as int) place
    from ({_base})"""
ORACLE["stored_append"] = "select * from signin_logs"
ORACLE["stored_json"] = ORACLE["doctor_directory"]


def needed_views(sql: str) -> list[str]:
    """The views a statement uses, in an order in which each may use earlier ones."""
    wanted: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in VIEWS:
            if name in words and name not in wanted:
                wanted.add(name)
                pending.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def statement(sql: str) -> str:
    """A complete statement over the sample tables: the needed views, then the query.

    A query may bring its own ``with recursive`` list; the views then precede it.
    """
    ctes = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed_views(sql))
    sql = sql.strip()
    own = "with recursive "
    if sql.startswith(own):
        return f"{own}{ctes},\n{sql[len(own):]}"
    return f"with {ctes}\n{sql}"
