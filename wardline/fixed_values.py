"""Fixed values.

Everything in this module is data that results depend on: identifiers, word
lists, seed rows, display formats and messages. Nothing here is derived.
"""

# --- identifiers -----------------------------------------------------------

SCHEDULED = 1
COMPLETED = 2
CANCELLED = 3

# --- word lists ------------------------------------------------------------

GENDERS = ("Male", "Female", "Other")
BLOOD_GROUPS = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
ACTION_STATES = ("Pending", "Completed", "Cancelled")
CONDITIONS = ("Stable", "Improving", "Critical", "Deteriorating")
PAYMENT_STATES = ("Unpaid", "Paid", "Partial")

# --- seed rows of the small dimensions -------------------------------------

SPECIALIZATIONS = (
    ("Cardiology", "Heart and cardiovascular specialist"),
    ("Neurology", "Brain and nervous system specialist"),
    ("Orthopedics", "Bone, joint, and muscle specialist"),
    ("Dermatology", "Skin and hair specialist"),
    ("Pediatrics", "Child health specialist"),
)
APPOINTMENT_STATUSES = ("Scheduled", "Completed", "Cancelled")
ACTION_TYPES = ("Admit", "X-Ray", "Blood Test", "Follow up checkup")

# Half-hour appointment slots: the first starts at 06:00, 24 of them.
FIRST_SLOT_MINUTE = 6 * 60
SLOT_MINUTES = 30
SLOTS_PER_DAY = 24

ROOM_TYPES = (
    ("GWARD-CARD-M", "General Ward Cardiology Male", 1500),
    ("GWARD-CARD-F", "General Ward Cardiology Female", 1500),
    ("GWARD-ORTHO-M", "General Ward Orthopedics Male", 1400),
    ("GWARD-ORTHO-F", "General Ward Orthopedics Female", 1400),
    ("GWARD-NEURO-M", "General Ward Neurology Male", 1600),
    ("GWARD-NEURO-F", "General Ward Neurology Female", 1600),
    ("GWARD-DERMA-M", "General Ward Dermatology Male", 1200),
    ("GWARD-DERMA-F", "General Ward Dermatology Female", 1200),
    ("GWARD-PED-M", "General Ward Pediatrics Male", 1300),
    ("GWARD-PED-F", "General Ward Pediatrics Female", 1300),
    ("PRIVATE ROOM", "Private Standard Room", 4000),
)
# (room number, room type id, floor)
ROOMS = (
    ("GW-CARD-M-1-01", 1, 1),
    ("GW-CARD-F-1-01", 2, 1),
    ("GW-ORTHO-M-2-01", 3, 2),
    ("GW-ORTHO-F-2-01", 4, 2),
    ("GW-NEURO-M-3-01", 5, 3),
    ("GW-NEURO-F-3-01", 6, 3),
    ("GW-DERMA-M-4-01", 7, 4),
    ("GW-DERMA-F-4-01", 8, 4),
    ("GW-PED-M-5-01", 9, 5),
    ("GW-PED-F-5-01", 10, 5),
    ("PR-6-01", 11, 6),
)

# --- wards -----------------------------------------------------------------

WARD_PREFIX = "GWARD"
PRIVATE_ROOM = "PRIVATE ROOM"
BEDS_PER_WARD = 8
BEDS_PER_PRIVATE_ROOM = 1
# Ward code inside a room type name -> department, first match wins.
WARD_DEPARTMENTS = (
    ("CARD", "Cardiology"),
    ("ORTHO", "Orthopedics"),
    ("NEURO", "Neurology"),
    ("DERMA", "Dermatology"),
    ("PED", "Pediatrics"),
)
OTHER_DEPARTMENT = "General"
# Ward suffix of a room type name -> gender.
WARD_GENDERS = (("-M", "Male"), ("-F", "Female"))
OTHER_WARD_GENDER = "Mixed"

# --- rules -----------------------------------------------------------------

BOOKING_HORIZON_DAYS = 7
CALENDAR_DAYS = 7
DEFAULT_DAILY_CHARGE = 1000
TEMPERATURE_RANGE = (90, 110)
OXYGEN_RANGE = (0, 100)
PULSE_RANGE = (0, 300)
SEARCH_MIN_CHARS = 2
VISIT_SUMMARY_DAYS = 30
RANGE_SUMMARY_DAYS = 30
RECENT_VISITS = 10
DISCHARGED_PATIENTS = 50
RECENT_DISCHARGES = 30
RECENT_SIGNINS = 20
RECENT_PATIENTS = 50

# --- display formats -------------------------------------------------------

ISO_DAY = "yyyy-MM-dd"
ISO_SECOND = "yyyy-MM-dd HH:mm:ss"
ISO_MINUTE = "yyyy-MM-dd HH:mm"
TIME_MINUTE = "HH:mm"
SLASH_DAY = "dd/MM/yyyy"
SLASH_MINUTE = "dd/MM/yyyy HH:mm"
LONG_DAY = "dd MMM yyyy"
LONG_MINUTE = "dd MMM yyyy HH:mm"
LONG_CLOCK = "dd MMM yyyy, hh:mm a"
US_MINUTE = "MMM dd, yyyy HH:mm"

# --- display text ----------------------------------------------------------

DOCTOR_TITLE = "Dr. "
NO_DIAGNOSIS = "Diagnosis pending"
NOT_AVAILABLE = "N/A"
NO_NAME = "Unknown"
NO_GENDER = "Not specified"
NO_SYMPTOMS = "No symptoms recorded"
NO_HISTORY = "No medical history recorded"
SLOT_BOOKED = "Booked"
SLOT_AVAILABLE = "Available"

# --- reasons given by slot checks and batch jobs ---------------------------

SLOT_PAST = "Cannot book appointments in the past"
SLOT_TOO_FAR = "Appointments can only be booked up to 7 days in advance"
SLOT_NOT_SCHEDULED = "Slot not in doctor's schedule for this day of week"
SLOT_INACTIVE = "Schedule inactive"
SLOT_TAKEN = "Already booked"

BOOK_REQUIRED = "patient_id, doctor_id, appointment_date, and slot_id are required"
BOOK_NO_PATIENT = "Patient not found"
BOOK_NO_DOCTOR = "Doctor not found"
BOOK_DUPLICATE = "Patient already has an appointment with this doctor on this date"
BOOK_NOT_SCHEDULED = "This slot is not in the doctor's schedule for this day"
BOOK_TAKEN = "This slot is already booked for the selected date"

FIELDS_REQUIRED = "Required fields missing"
INVALID_REFERENCE = "Referenced row not found"
DUPLICATE_KEY = "Duplicate key"
INVALID_VALUE = "Value breaks a table rule"
NOTHING_TO_UPDATE = "No fields to update"
NOT_FOUND = "Not found"
STILL_REFERENCED = "Referenced by other rows"

FORM_NOT_OWNED = "Appointment not found or does not belong to this patient"
FORM_EXISTS = "Appointment form already exists for this appointment"

VISIT_NO_ADMISSION = "Active admission not found for the specified patient and doctor"
VISIT_TEMPERATURE = "Temperature must be between 90 and 110°F"
VISIT_OXYGEN = "Oxygen saturation must be between 0 and 100%"
VISIT_PULSE = "Pulse rate must be between 0 and 300 BPM"
VISIT_CONDITION = "Condition status must be one of: Stable, Improving, Critical, Deteriorating"

BED_NOT_FOUND = "Bed not found"
BED_OCCUPIED = "Bed is already occupied"

ADMISSION_NOT_FOUND = "Admission not found"
ADMISSION_CLOSED = "Admission already discharged"
ADMISSION_NOT_ACTIVE = "Active admission not found"
BILL_TOO_SMALL = "Invalid total_bill amount. Room charges exceed total bill."
