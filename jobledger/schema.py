"""The accounting layout, default capacities and report labels."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType

# The 109 accounting columns in the order of the dump, and those that hold integers.
ACCOUNTING_COLUMNS = [
    "Account",
    "AdminComment",
    "AllocCPUS",
    "AllocNodes",
    "AllocTRES",
    "AssocID",
    "AveCPU",
    "AveCPUFreq",
    "AveDiskRead",
    "AveDiskWrite",
    "AvePages",
    "AveRSS",
    "AveVMSize",
    "BlockID",
    "Cluster",
    "Comment",
    "Constraints",
    "ConsumedEnergy",
    "ConsumedEnergyRaw",
    "Container",
    "CPUTime",
    "CPUTimeRAW",
    "DBIndex",
    "DerivedExitCode",
    "Elapsed",
    "ElapsedRaw",
    "Eligible",
    "End",
    "ExitCode",
    "Flags",
    "GID",
    "Group",
    "JobID",
    "JobIDRaw",
    "JobName",
    "Layout",
    "MaxDiskRead",
    "MaxDiskReadNode",
    "MaxDiskReadTask",
    "MaxDiskWrite",
    "MaxDiskWriteNode",
    "MaxDiskWriteTask",
    "MaxPages",
    "MaxPagesNode",
    "MaxPagesTask",
    "MaxRSS",
    "MaxRSSNode",
    "MaxRSSTask",
    "MaxVMSize",
    "MaxVMSizeNode",
    "MaxVMSizeTask",
    "McsLabel",
    "MinCPU",
    "MinCPUNode",
    "MinCPUTask",
    "NCPUS",
    "NNodes",
    "NodeList",
    "NTasks",
    "Partition",
    "Priority",
    "QOS",
    "QOSRAW",
    "Reason",
    "ReqCPUFreq",
    "ReqCPUFreqGov",
    "ReqCPUFreqMax",
    "ReqCPUFreqMin",
    "ReqCPUS",
    "ReqMem",
    "ReqNodes",
    "ReqTRES",
    "Reservation",
    "ReservationId",
    "Reserved",
    "ResvCPU",
    "ResvCPURAW",
    "Start",
    "State",
    "Submit",
    "SubmitLine",
    "Suspended",
    "SystemComment",
    "SystemCPU",
    "Timelimit",
    "TimelimitRaw",
    "TotalCPU",
    "TRESUsageInAve",
    "TRESUsageInMax",
    "TRESUsageInMaxNode",
    "TRESUsageInMaxTask",
    "TRESUsageInMin",
    "TRESUsageInMinNode",
    "TRESUsageInMinTask",
    "TRESUsageInTot",
    "TRESUsageOutAve",
    "TRESUsageOutMax",
    "TRESUsageOutMaxNode",
    "TRESUsageOutMaxTask",
    "TRESUsageOutMin",
    "TRESUsageOutMinNode",
    "TRESUsageOutMinTask",
    "TRESUsageOutTot",
    "UID",
    "User",
    "UserCPU",
    "WCKey",
    "WCKeyID",
    "WorkDir",
]

INTEGER_COLUMNS = [
    "AllocCPUS",
    "AllocNodes",
    "AssocID",
    "AvePages",
    "ConsumedEnergy",
    "ConsumedEnergyRaw",
    "CPUTimeRAW",
    "DBIndex",
    "ElapsedRaw",
    "GID",
    "MaxDiskReadTask",
    "MaxDiskWriteTask",
    "MaxPages",
    "MaxPagesTask",
    "MaxRSSTask",
    "MaxVMSizeTask",
    "MinCPUTask",
    "NCPUS",
    "NNodes",
    "NTasks",
    "Priority",
    "QOSRAW",
    "ReqCPUS",
    "ReqNodes",
    "ResvCPURAW",
    "UID",
    "WCKeyID",
]

# The columns of the per-job efficiency export, in its order.
JOB_REPORT_COLUMNS = [
    "Account",
    "AllocCPUS",
    "AllocNodes",
    "AveCPU",
    "AveCPUFreq",
    "AveDiskRead",
    "AveDiskWrite",
    "AvePages",
    "AveRSS",
    "AveVMSize",
    "Comment",
    "CPUTime",
    "CPUTimeRAW",
    "DerivedExitCode",
    "Elapsed",
    "ElapsedRaw",
    "End",
    "ExitCode",
    "Flags",
    "Group",
    "JobID",
    "JobName",
    "MaxDiskRead",
    "MaxDiskReadNode",
    "MaxDiskReadTask",
    "MaxDiskWrite",
    "MaxDiskWriteNode",
    "MaxDiskWriteTask",
    "MaxPages",
    "MaxPagesNode",
    "MaxPagesTask",
    "MaxRSS",
    "MaxRSSNode",
    "MaxRSSTask",
    "MaxVMSize",
    "MaxVMSizeNode",
    "MaxVMSizeTask",
    "MinCPU",
    "MinCPUNode",
    "MinCPUTask",
    "NCPUS",
    "NNodes",
    "NodeList",
    "NTasks",
    "Partition",
    "QOS",
    "ReqCPUS",
    "ReqMem",
    "ReqNodes",
    "Start",
    "State",
    "Submit",
    "SubmitLine",
    "Suspended",
    "SystemCPU",
    "Timelimit",
    "TimelimitRaw",
    "TotalCPU",
    "User",
    "UserCPU",
    "WorkDir",
]
JOB_REPORT_DERIVED = ["ReqMem_G", "MaxRSS_G", "MemEfficiencyPercent", "CPUEfficiencyPercent"]

SEPARATOR = "|"

# What the cluster can deliver in a day (CPU seconds, gigabyte seconds).
DEFAULT_CAPACITY = {"cpu_seconds": 36633600, "gb_seconds": 188611200}

# The daily metrics in report order, our column name and the label used in the JSON export.
DAILY_METRICS = {
    "cpu_seconds": "CPU.Secondes",
    "cpu_hours": "CPU.Heures",
    "cpu_usage_percent": "Pourcentage d'utilisation CPU",
    "gb_seconds": "GB.Secondes",
    "ram_usage_percent": "Taux d'occupation de la RAM",
    "wait_mean": "Temps d'attente moyen en queue (secondes)",
    "wait_median": "Temps d'attente médian en queue (secondes)",
    "wait_min": "Temps d'attente minimum en queue (secondes)",
    "wait_max": "Temps d'attente maximum en queue (secondes)",
    "jobs_submitted": "Jobs soumis",
    "jobs_started": "Jobs démarrés",
    "jobs_ended": "Jobs terminés",
    "jobs_completed": "Jobs terminés avec succès",
    "jobs_failed": "Jobs échoués",
    "jobs_preempted": "Jobs préemptés",
    "duration_mean": "Durée moyenne d'exécution (secondes)",
    "duration_median": "Durée médiane d'exécution (secondes)",
    "duration_min": "Durée minimum d'exécution (secondes)",
    "duration_max": "Durée maximum d'exécution (secondes)",
}
# The two metrics the calendar shows.
CALENDAR_METRICS = ["ram_usage_percent", "cpu_usage_percent"]

# Inclusive percent bands and their colours.
EFFICIENCY_BANDS = [
    (0, 20, "#ff0000"),
    (21, 60, "#d4a500"),
    (61, 75, "#ffa500"),
    (76, 100, "#008000"),
    (101, 125, "#ffa500"),
    (126, 150, "#ff0000"),
]

# The per-rule tables, one per measure, with the headings of mean, median, deviation, minimum, maximum.
RULE_HEADING = "Nom de la règle"
RULE_TABLES = {
    "MemEfficiencyPercent": [
        "Efficacité mémoire moyenne",
        "Efficacité mémoire médiane",
        "Efficacité mémoire (écart-type)",
        "Efficacité mémoire minimum",
        "Efficacité mémoire maximum",
    ],
    "CPUEfficiencyPercent": [
        "Efficacité CPU moyenne",
        "Efficacité CPU médiane",
        "Efficacité CPU (écart-type)",
        "Efficacité CPU minimum",
        "Efficacité CPU maximum",
    ],
    "ElapsedRaw": [
        "Durée moyenne",
        "Durée médiane",
        "Durée (écart-type)",
        "Durée minimum",
        "Durée maximum",
    ],
    "UsedRAMPerMo": [
        "RAM utilisée par Mo (moyenne)",
        "RAM utilisée par Mo (médiane)",
        "RAM utilisée par Mo (écart-type)",
        "RAM utilisée par Mo (minimum)",
        "RAM utilisée par Mo (maximum)",
    ],
    "MinPerMo": [
        "Minutes par Mo (moyenne)",
        "Minutes par Mo (médiane)",
        "Minutes par Mo (écart-type)",
        "Minutes par Mo (minimum)",
        "Minutes par Mo (maximum)",
    ],
}
RULE_MEASURES = ["MemEfficiencyPercent", "CPUEfficiencyPercent", "ElapsedRaw"]
SIZED_RULE_MEASURES = ["UsedRAMPerMo", "MinPerMo"]
# The headings whose cells are coloured: efficiency percents, not their deviation.
BANDED_HEADINGS = [
    heading
    for measure in ("MemEfficiencyPercent", "CPUEfficiencyPercent")
    for heading in RULE_TABLES[measure]
    if "écart-type" not in heading
]


def column_type(name: str):
    return LongType() if name in INTEGER_COLUMNS else StringType()


ACCOUNTING_SCHEMA = StructType([StructField(name, column_type(name)) for name in ACCOUNTING_COLUMNS])

INPUT_SIZE_SCHEMA = StructType(
    [
        StructField("slurm_jobid", StringType()),
        StructField("job_id", StringType()),
        StructField("rule_name", StringType()),
        StructField("input_size_bytes", LongType()),
        StructField("inputs", StringType()),
    ]
)
