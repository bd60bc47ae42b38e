"""Resource and column registry: event time, history columns, keys."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Resource:
    name: str
    time: str
    text: tuple[str, ...]
    keys: tuple[str, ...] = ()
    text_by_task: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def columns(self, task: str | None = None) -> tuple[str, ...]:
        return self.text_by_task.get(task, self.text)


# Event time, history columns and unique keys per resource.
RESOURCES = {
    r.name: r
    for r in (
        Resource("condition", "condition_date", ("icd_code", "icd_display"), ("patient_id", "condition_id")),
        Resource("procedure", "start", ("code", "display"), ("patient_id", "procedure_id")),
        Resource(
            "imaging_study",
            "started",
            ("description", "procedure_code"),
            ("patient_id", "imaging_study_id"),
            {"ds_image": ("description", "modality_code", "procedure_code")},
        ),
        Resource("biologically_derived_product", "ausgabe_datetime", ("output_to_einskurz", "display")),
        Resource("observation", "effectivedatetime", ("display", "value_quantity", "value_unit")),
        Resource("service_request", "authored", ("code_display", "category_display")),
        Resource("medication", "datetime", ("medication", "status")),
        Resource(
            "episode_of_care",
            "start",
            ("cert", "primary_case", "primary_year", "first_diagnosis_date", "treatment_program"),
        ),
        Resource("diagnostic_report", "date", ("category_display", "title")),
    )
}

# Resources that enter a history, by task.
DEFAULT_RESOURCES = tuple(RESOURCES)
TASK_RESOURCES = {
    "ds_image": ("condition", "procedure", "imaging_study", "diagnostic_report", "episode_of_care"),
    "ds_icd": ("condition", "procedure"),
    "pretrain_documents": ("diagnostic_report",),
}

# Columns that must not be null; True means error, False warning.
REQUIRED_COLUMNS = {
    "condition": (("patient_id", True), ("icd_code", True)),
    "encounter": (("patient_id", True),),
    "biologically_derived_product": (("ausgabe_datetime", False),),
    "patient": (("patient_id", True),),
    "procedure": (("patient_id", False),),
    "observation": (("patient_id", True), ("value_quantity", True)),
    "imaging_study": (("patient_id", True),),
    "episode_of_care": (("patient_id", True),),
    "service_request": (("patient_id", True),),
    "diagnostic_report": (("patient_id", True),),
    "medication": (("patient_id", True),),
}


def resources_for(task: str, use: dict[str, bool] | None = None) -> tuple[str, ...]:
    """Resources of a task's history, minus those switched off in ``use``."""
    names = TASK_RESOURCES.get(task, DEFAULT_RESOURCES)
    return tuple(n for n in names if (use or {}).get(n, True))
