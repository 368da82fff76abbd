"""The hospital tables over the sample files as DuckDB views, and the request views.

The SQL is the specification of the adapter; the Spark side builds the same frames
with the DataFrame API, so the two are independent.
"""

VIEWS: dict[str, str] = {}

VIEWS["specializations"] = """
select cast(r_regionkey + 1 as int) specialization_id,
  case r_regionkey when 0 then 'Cardiology' when 1 then 'Neurology' when 2 then 'Orthopedics'
    when 3 then 'Dermatology' else 'Pediatrics' end specialization_name
from region
"""

VIEWS["doctors"] = """
select s_suppkey doctor_id, concat('D', s_suppkey) doctor_login_id,
  split_part(s_name, '#', 1) first_name, split_part(s_name, '#', 2) last_name,
  cast(30 + s_suppkey % 40 as int) age, cast(s_nationkey % 5 + 1 as int) specialization_id,
  cast(500 + (s_suppkey % 20) * 50 as decimal(10,2)) consultation_fee,
  concat('0300', s_suppkey) phone_no, cast(s_suppkey % 40 as int) experience_years,
  concat('REG-', s_suppkey) registration_number, cast(s_suppkey + 1 as int) room_no
from supplier
"""

VIEWS["patients"] = """
select c_custkey patient_id, concat('P', c_custkey) patient_login_id,
  split_part(c_name, '#', 1) first_name, split_part(c_name, '#', 2) last_name,
  cast((c_custkey * 7) % 100 as int) age,
  case c_custkey % 3 when 0 then 'Male' when 1 then 'Female' else 'Other' end gender,
  case c_custkey % 4 when 0 then 'A+' when 1 then 'B+' when 2 then 'AB-' else 'O-' end blood_group,
  concat('0311', c_custkey) phone_no,
  date '1995-01-01' + cast((c_custkey * 13) % 2400 as int) created_at
from customer
"""

VIEWS["receptionists"] = """
select n_nationkey + 5 receptionist_id, concat('R', n_nationkey + 5) receptionist_login_id,
  'Desk' first_name, n_name last_name, concat('0322', n_nationkey) contact_no
from nation
"""

VIEWS["admin"] = """
select 1 admin_id, 'A1' admin_login_id, 'root' username
"""

VIEWS["time_slots"] = """
select n_nationkey + 1 slot_id, n_nationkey + 1 slot_number, 360 + 30 * n_nationkey start_min,
  390 + 30 * n_nationkey end_min
from nation where n_nationkey < 24
"""

VIEWS["doctor_schedules"] = """
select (s_suppkey * 7 + d.n_nationkey) * 24 + t.n_nationkey schedule_id, s_suppkey doctor_id,
  d.n_nationkey day_of_week, t.n_nationkey + 1 slot_id,
  (s_suppkey + t.n_nationkey) % 11 <> 0 is_active
from supplier cross join nation d cross join nation t
where d.n_nationkey < 7 and t.n_nationkey < 24 and (s_suppkey + d.n_nationkey + t.n_nationkey) % 3 <> 0
"""

VIEWS["appointment_statuses"] = """
select n_nationkey + 1 status_id,
  case n_nationkey when 0 then 'Scheduled' when 1 then 'Completed' else 'Cancelled' end status_name
from nation where n_nationkey < 3
"""

VIEWS["action_types"] = """
select n_nationkey + 1 action_type_id,
  case n_nationkey when 0 then 'Admit' when 1 then 'X-Ray' when 2 then 'Blood Test'
    else 'Follow up checkup' end action_name
from nation where n_nationkey < 4
"""

VIEWS["appointments"] = """
select o_orderkey appointment_id, o_custkey patient_id,
  o_orderkey % (select count(*) from supplier) doctor_id,
  cast(o_orderdate as date) appointment_date, cast(o_orderkey % 24 + 1 as int) slot_id,
  case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end status_id, o_orderdate created_at
from orders
"""

VIEWS["appointment_forms"] = """
select o_orderkey form_id, o_orderkey appointment_id, o_custkey patient_id, o_orderpriority symptoms,
  case when o_orderkey % 4 = 0 then null else 'none' end medical_history, o_orderdate created_at
from orders where o_orderkey % 2 = 0
"""

VIEWS["appointment_cancellations"] = """
select o_orderkey cancellation_id, o_orderkey appointment_id, o_custkey patient_id,
  o_orderpriority cancellation_reason, o_orderdate cancelled_at
from orders where o_orderstatus = 'P'
"""

VIEWS["consultations"] = """
select o_orderkey consultation_id, o_orderkey appointment_id,
  o_orderkey % (select count(*) from supplier) doctor_id, o_custkey patient_id,
  case when o_orderkey % 5 = 0 then null else concat(100 + o_orderkey % 40, '/', 60 + o_orderkey % 30) end blood_pressure,
  case when o_orderkey % 6 = 0 then null else cast(96 + (o_orderkey % 80) * 0.1 as decimal(5,2)) end temperature,
  case when o_orderkey % 8 = 0 then null else cast(85 + o_orderkey % 16 as int) end oxygen_saturation,
  case when o_orderkey % 7 = 0 then null else o_orderpriority end diagnosis,
  o_orderdate consultation_date
from orders where o_orderstatus = 'F'
"""

VIEWS["prescribed_medicines"] = """
select row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)
    * (select max(o_orderkey) + 1 from orders) + l_orderkey medicine_id,
  l_orderkey consultation_id, p_name medicine_name, concat(cast(l_quantity as int), 'mg') dosage,
  p_type frequency, concat(l_linenumber, ' days') duration, l_shipdate created_at
from lineitem join part on l_partkey = p_partkey join consultations c on c.consultation_id = l_orderkey
"""

VIEWS["consultation_actions"] = """
select o_orderkey action_id, o_orderkey consultation_id, cast(o_orderkey % 4 + 1 as int) action_type_id,
  case when o_orderkey % 12 = 0 then 'Pending' else 'Completed' end status,
  o_orderpriority notes, o_orderdate created_at
from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0
"""

VIEWS["room_types"] = """
select n_nationkey + 1 room_type_id,
  case n_nationkey when 0 then 'GWARD-CARD-M' when 1 then 'GWARD-CARD-F' when 2 then 'GWARD-ORTHO-M'
    when 3 then 'GWARD-ORTHO-F' when 4 then 'GWARD-NEURO-M' when 5 then 'GWARD-NEURO-F'
    when 6 then 'GWARD-DERMA-M' when 7 then 'GWARD-DERMA-F' when 8 then 'GWARD-PED-M'
    when 9 then 'GWARD-PED-F' else 'PRIVATE ROOM' end type_name,
  cast(case when n_nationkey < 2 then 1500 when n_nationkey < 4 then 1400 when n_nationkey < 6 then 1600
    when n_nationkey < 8 then 1200 when n_nationkey < 10 then 1300 else 4000 end as decimal(10,2)) per_day_charges
from nation where n_nationkey < 11
"""

VIEWS["admissions"] = """
select o_orderkey admission_id, o_custkey patient_id,
  o_orderkey % (select count(*) from supplier) doctor_id, o_orderkey consultation_id,
  o_orderkey action_id, cast(place // 81 * 11 + place % 81 // 8 + 1 as int) initial_room_id,
  cast(place + 1 as int) bed_id, o_orderdate admission_date,
  case when o_orderkey % 20 = 0 then null
    else o_orderdate + cast(3 + o_orderkey % 5 as int) * interval '1' day end discharge_date,
  o_orderkey % 20 = 0 is_active, o_orderpriority admission_notes,
  5 + o_orderkey % 25 assigned_by_receptionist_id
from (select *, o_orderkey % (81 * (select (count(*) + 9) // 10 from supplier)) place from orders)
where o_orderstatus = 'F' and o_orderkey % 4 = 0
"""

# Ward blocks: eleven rooms and 81 beds for every ten doctors begun.
VIEWS["places"] = """
select cast(k * 81 + r.n_nationkey * 8 + b.n_nationkey + 1 as int) bed_id,
  cast(k * 11 + r.n_nationkey + 1 as int) room_id, r.n_nationkey + 1 room_type_id,
  cast(r.n_nationkey as int) % 6 + 1 floor_number, b.n_nationkey + 1 bed_number
from (select distinct s_suppkey // 10 k from supplier) cross join nation r cross join nation b
where r.n_nationkey < 11 and b.n_nationkey < 8 and (r.n_nationkey < 10 or b.n_nationkey = 0)
"""

VIEWS["beds"] = """
select p.bed_id, p.room_id, p.bed_number, concat('R', p.room_id, '-B', p.bed_number) bed_code,
  a.bed_id is not null is_occupied
from places p left join (select distinct bed_id from admissions where is_active and bed_id % 3 = 0) a
  on a.bed_id = p.bed_id
"""

VIEWS["rooms"] = """
select p.room_id, concat('ROOM-', p.room_id) room_number, p.room_type_id, p.floor_number, x.full_room is_occupied
from places p join (select room_id, min(case when is_occupied then 1 else 0 end) = 1 full_room
  from beds group by room_id) x on x.room_id = p.room_id
where p.bed_number = 1
"""

VIEWS["admitted_patient_visits"] = """
select row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)
    * (select max(o_orderkey) + 1 from orders) + l_orderkey visit_id,
  a.admission_id, a.patient_id, a.doctor_id, l_shipdate visit_datetime,
  concat(100 + l_linenumber, '/', 70 + l_linenumber) blood_pressure,
  cast(90 + l_quantity * 0.4 as double) temperature, cast(round(100 - l_discount * 100) as int) oxygen_saturation,
  cast(60 + l_quantity as int) pulse_rate,
  case cast(l_quantity as int) % 4 when 0 then 'Stable' when 1 then 'Improving' when 2 then 'Critical'
    else 'Deteriorating' end condition_status,
  l_returnflag = 'R' ready_for_discharge,
  case when l_returnflag = 'R' then l_shipdate + interval '1' day end discharge_recommended_date
from lineitem join admissions a on l_orderkey = a.admission_id
"""

VIEWS["discharges"] = """
select a.admission_id discharge_id, a.admission_id, a.patient_id, a.doctor_id, a.discharge_date,
  cast(3 + a.admission_id % 5 as int) total_days,
  cast(floor(o_totalprice * 0.5) as decimal(12,2)) room_charges, cast(floor(o_totalprice * 0.25) as decimal(12,2)) medical_charges,
  cast(0 as decimal(12,2)) doctor_visit_charges, cast(0 as decimal(12,2)) lab_charges, cast(0 as decimal(12,2)) other_charges,
  cast(o_totalprice as decimal(12,2)) total_amount,
  case a.admission_id % 3 when 0 then 'Unpaid' when 1 then 'Paid' else 'Partial' end payment_status,
  cast(case a.admission_id % 3 when 0 then 0 when 1 then o_totalprice else 100 end as decimal(12,2)) amount_paid,
  o_orderpriority final_diagnosis, a.admission_id % 8 = 0 follow_up_required,
  a.assigned_by_receptionist_id processed_by_receptionist_id
from admissions a join orders on o_orderkey = a.admission_id where not a.is_active
"""

VIEWS["removed_doctors"] = """
select s_suppkey removed_doctor_id, s_suppkey doctor_id, s_name doctor_name,
  cast(s_nationkey % 5 + 1 as int) specialization_id, 'left' removal_reason, 1 removed_by_admin_id,
  date '2001-01-01' + cast(s_suppkey % 200 as int) removal_date
from supplier where s_suppkey % 10 = 9
"""

VIEWS["signin_logs"] = """
select event_id log_id, concat('', user_id) user_id,
  case event_type when 'error' then 'admin' when 'view' then 'doctor' when 'purchase' then 'receptionist'
    else 'patient' end user_type, ts signin_datetime
from events
"""

VIEWS["booking_requests"] = """
select event_id request_id, ts requested_at, event_id % (select greatest(1, count(*) * 2 // 15) from customer) patient_id,
  user_id % (select greatest(1, count(*) * 3 // 25) from supplier) doctor_id,
  date '2001-08-01' + cast(event_id % 11 - 1 as int) appointment_date, cast(event_id % 26 + 1 as int) slot_id
from events
"""

VIEWS["signup_logs"] = """
select patient_id signup_log_id, patient_id, first_name, last_name, created_at signup_datetime from patients
"""

# --- reference lists that grow with the sample ----------------------------------

VIEWS["long_specializations"] = """
select p_partkey + 1 specialization_id, p_name specialization_name from part
"""
VIEWS["long_time_slots"] = """
select p_partkey + 1 slot_id, cast(p_partkey + 1 as int) slot_number, cast(p_partkey * 7 % 1410 as int) start_min,
  cast(p_partkey * 7 % 1410 + 30 as int) end_min from part
"""
VIEWS["long_action_types"] = """
select p_partkey + 1 action_type_id, p_type action_name from part
"""
VIEWS["long_receptionists"] = """
select c_custkey + 5 receptionist_id, concat('R', c_custkey + 5) receptionist_login_id, c_mktsegment first_name,
  c_name last_name, concat('0322', c_custkey) contact_no from customer
"""
VIEWS["long_room_types"] = """
select p_partkey + 1 room_type_id, concat(case p_size % 3 when 0 then 'GWARD-' when 1 then 'PRIVATE ' else 'DAY-' end,
    upper(p_type), case p_partkey % 3 when 0 then '-M' when 1 then '-F' else '' end) type_name,
  cast(p_retailprice as decimal(10,2)) per_day_charges from part
"""

# --- request views of the batch jobs ------------------------------------------

VIEWS["visit_requests"] = """
select event_id request_id, ts requested_at, event_id % (select greatest(1, count(*) * 4 // 75) from orders) * 20 admission_id,
  case when event_id % 7 = 0 then a.patient_id + 1 else a.patient_id end patient_id, a.doctor_id,
  concat(100 + event_id % 40, '/', 60 + event_id % 30) blood_pressure, cast(88 + event_id % 23 as double) temperature,
  cast(event_id % 103 as int) oxygen_saturation, cast(event_id % 311 as int) pulse_rate,
  case event_id % 6 when 0 then 'Stable' when 1 then 'Improving' when 2 then 'Critical' when 3 then 'Deteriorating'
    when 4 then 'Fair' end condition_status, event_id % 3 = 0 ready_for_discharge,
  case event_id % 5 when 0 then ts when 1 then timestamp '1990-01-01 00:00:00' end discharge_recommended_date
from events left join admissions a on a.admission_id = event_id % (select greatest(1, count(*) * 4 // 75) from orders) * 20
"""
VIEWS["admit_requests"] = """
select ca.action_id request_id, ca.created_at requested_at,
  case when ca.action_id % 28 = 0 then null else c.patient_id end patient_id, c.doctor_id, ca.consultation_id,
  ca.action_id, cast(ca.action_id % (11 * (select (count(*) + 9) // 10 from supplier)) + 1 as int) initial_room_id,
  cast(ca.action_id % (90 * (select (count(*) + 9) // 10 from supplier)) + 1 as int) bed_id,
  ca.notes admission_notes, 5 + ca.action_id % 27 assigned_by_receptionist_id
from consultation_actions ca join consultations c on c.consultation_id = ca.consultation_id
where ca.action_type_id = 1
"""
VIEWS["discharge_requests"] = """
select event_id request_id, ts requested_at,
  event_id % (select greatest(1, count(*) * 4 // 75) from orders) * 20 + case when event_id % 9 = 0 then 4 else 0 end admission_id,
  user_id % (select greatest(1, count(*) * 1 // 15) from customer) + 1 patient_id,
  user_id % (select greatest(1, count(*) * 3 // 25) from supplier) doctor_id,
  cast(event_id % (81 * (select (count(*) + 9) // 10 from supplier)) + 1 as int) bed_id,
  cast(round(value * 20000) as decimal(12,2)) total_bill, cast(round(value * 10) as decimal(12,2)) final_bill_amount,
  case when event_id % 5 <> 0 then cast(event_id % 1000 as decimal(12,2)) end room_charges,
  cast(round(value) as decimal(12,2)) medical_charges, cast(event_id % 40 - 1 as decimal(12,2)) lab_charges,
  case when event_id % 4 = 0 then timestamp '2001-08-05 10:00:00' end discharge_date,
  5 + event_id % 26 discharged_by_receptionist_id, 5 + event_id % 26 processed_by_receptionist_id
from events
"""
VIEWS["bed_requests"] = """
select event_id request_id, ts requested_at, user_id + 1 bed_id, value < 20 is_occupied from events
"""
VIEWS["schedule_patches"] = """
select event_id request_id, ts requested_at, event_id % (select greatest(1, count(*) * 40 // 1) from supplier) schedule_id,
  event_id % 2 = 0 has_day, cast(event_id % 9 as int) new_day, event_id % 3 = 0 has_slot,
  cast(event_id % 25 + 1 as int) new_slot, event_id % 5 = 0 has_active, event_id % 10 = 0 new_active
from events
"""
VIEWS["action_patches"] = """
select event_id request_id, ts requested_at, event_id * 2 action_id, event_id % 2 = 0 has_status,
  case event_id % 8 when 0 then 'Completed' when 2 then 'Cancelled' when 4 then 'Pending' else 'Open' end new_status,
  event_id % 3 = 0 has_notes, case when event_id % 6 = 0 then props end new_notes
from events
"""
VIEWS["visit_patches"] = """
select visit_id request_id, ts requested_at, visit_id,
  event_id % 3 = 0 has_temperature, case when event_id % 9 = 0 then 'hot' else '98.60' end new_temperature,
  event_id % 5 = 0 has_pulse, cast(200 + event_id % 150 as int) new_pulse, event_id % 7 = 0 has_condition,
  event_id % 8 = 0 has_ready, event_id % 16 = 0 new_ready
from events join admitted_patient_visits v on v.admission_id = event_id
"""
VIEWS["follow_up_patches"] = """
select event_id request_id, ts requested_at, event_id * 4 discharge_id, event_id % 2 = 0 has_required,
  event_id % 4 = 0 new_required, event_id % 3 = 0 has_date, event_id % 5 = 0 has_notes, props new_notes
from events
"""
VIEWS["removal_requests"] = """
select event_id request_id, ts requested_at, event_id % (select greatest(1, count(*) * 13 // 10) from supplier) doctor_id,
  case when event_id % 11 = 0 then '' else event_type end removal_reason,
  case when event_id % 13 = 0 then 2 else 1 end removed_by_admin_id
from events
"""
VIEWS["schedule_deletions"] = """
select event_id request_id, ts requested_at, event_id % (select greatest(1, count(*) * 60 // 1) from supplier) schedule_id from events
"""
VIEWS["slot_deletions"] = """
select c_custkey request_id, timestamp '2001-08-01 00:00:00' requested_at, c_custkey % 40 * 2 slot_id from customer
"""
VIEWS["new_patients"] = """
select c_custkey request_id, timestamp '2001-08-01 00:00:00' requested_at,
  case when c_custkey % 10 = 0 then '' else c_mktsegment end first_name, c_name last_name,
  cast(c_custkey % 160 as int) age,
  case c_custkey % 4 when 0 then 'Male' when 1 then 'female' when 2 then 'Other' else 'None' end gender,
  case when c_custkey % 2 = 0 then 'A+' else '' end blood_group
from customer
"""
VIEWS["new_doctors"] = """
select p_partkey request_id, timestamp '2001-08-01 00:00:00' requested_at, p_brand first_name, p_type last_name,
  p_size + 15 age, cast(p_partkey % 7 as int) specialization_id,
  cast(p_partkey % 3 * 100 as decimal(10,2)) consultation_fee, cast(p_partkey % 9 as int) experience_years,
  case when p_partkey % 6 <> 0 then concat('REG-', p_partkey % (select greatest(1, count(*) * 3 // 1) from supplier)) end registration_number
from part
"""
VIEWS["new_forms"] = """
select event_id request_id, ts requested_at, event_id % (select greatest(1, count(*) * 2 // 5) from orders) appointment_id,
  case when event_id % 8 = 0 then o_custkey + 1 else o_custkey end patient_id, o_orderpriority symptoms
from events left join orders on o_orderkey = event_id % (select greatest(1, count(*) * 2 // 5) from orders)
"""
VIEWS["raw_visits"] = """
select case when pulse_rate % 7 = 0 then admission_id else visit_id end visit_id,
  case when pulse_rate % 10 = 0 then -1 else admission_id end admission_id, patient_id,
  case when pulse_rate % 9 = 0 then null else doctor_id end doctor_id, visit_datetime, temperature + 5 temperature,
  oxygen_saturation, pulse_rate * 4 pulse_rate,
  case when pulse_rate % 8 = 0 then 'Fair' else condition_status end condition_status, ready_for_discharge
from admitted_patient_visits
"""
VIEWS["new_consultations"] = """
select event_id request_id, ts requested_at, event_id % (select greatest(1, count(*) * 7 // 15) from orders) appointment_id,
  case when event_id % 50 = 0 then 999999999 else a.doctor_id end doctor_id, a.patient_id,
  case when event_id % 4 = 0 then '' else '120/80' end blood_pressure,
  case when event_id % 3 = 0 then 0.0 else 98.5 end temperature
from events left join appointments a on a.appointment_id = event_id % (select greatest(1, count(*) * 7 // 15) from orders)
"""
VIEWS["new_schedules"] = """
select event_id request_id, ts requested_at, user_id % (select greatest(1, count(*) * 11 // 10) from supplier) doctor_id,
  case when event_id % 40 <> 0 then cast(event_id % 8 as int) end day_of_week, cast(event_id % 26 as int) slot_id,
  case when event_id % 3 = 0 then false end is_active
from events
"""
VIEWS["new_medicines"] = """
select event_id request_id, ts requested_at, event_id consultation_id, event_type medicine_name,
  case when event_id % 9 = 0 then '' else '5mg' end dosage,
  case when event_id % 10 = 0 then repeat('x', 51) else 'daily' end frequency, '3 days' duration
from events
"""
VIEWS["new_receptionists"] = """
select c_custkey request_id, timestamp '2001-08-01 00:00:00' requested_at, c_mktsegment first_name,
  case when c_custkey % 6 = 0 then null else c_name end last_name,
  case when c_custkey % 4 = 0 then '' else concat('0322', c_custkey) end contact_no
from customer
"""
VIEWS["new_actions"] = """
select event_id request_id, ts requested_at, event_id consultation_id, event_id % 6 action_type_id, props notes
from events
"""
VIEWS["new_signins"] = """
select event_id request_id, ts requested_at, concat('', user_id) user_id,
  case when event_type <> 'error' then event_type end user_type
from events
"""
VIEWS["room_requests"] = """
select event_id request_id, ts requested_at, user_id % (13 * (select (count(*) + 9) // 10 from supplier)) + 1 room_id, value < 50 is_occupied from events
"""
