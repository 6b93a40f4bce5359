"""Keywords of common subject areas in the languages handled here, as a dictionary or a section index has them.

They add to the titles and scope notes of the table of areas, which are in two languages only, and are a parameter
of the operator. They are words, no pieces of sentences of any corpus; areas that are not listed go by their titles.
"""

KEYWORDS: dict[str, str] = {
    "clinical_medicine": "chẩn đoán; điều trị; phẫu thuật; triệu chứng; kê đơn; diagnosis; treatment; surgery; surgeon; patient; symptom; prescription; "
    "chirurgie; traitement; symptôme; patient; malade; diagnostic; 诊断; 手术; 治疗; 症状; 診断; 手術; 治療; วินิจฉัย; ผ่าตัด; รักษา; อาการ",
    "disease_prevention": "phòng bệnh; dinh dưỡng; tiêm chủng; vắc xin; vệ sinh; prevention; nutrition; vaccin; hygiene; healthy; "
    "prévention; hygiène; 预防; 疫苗; 予防; 接種; ป้องกัน; วัคซีน",
    "biomedical_research": "nghiên cứu; thử nghiệm; phòng thí nghiệm; giả thuyết; nhà khoa học; study; laborator; research; hypothesis; "
    "scientist; étude; laboratoire; 研究; 实验室; 実験; 研究; วิจัย; ห้องปฏิบัติการ",
    "law_crime": "pháp luật; hình sự; bị cáo; cảnh sát; luật sư; court; crime; police; judge; prosecutor; tribunal; procureur; 法院; 警方; "
    "裁判; 警察; ศาล; ตำรวจ",
    "health_administration": "bổ nhiệm; đấu thầu; viện phí; ngân sách; thanh tra; tender; fees; budget; minister; policy; ministère; "
    "budget; 预算; 招标; 予算; 入札; งบประมาณ; ประมูล",
    "veterinary": "thú y; vật nuôi; chăn nuôi; gia súc; gia cầm; veterinar; livestock; cattle; animal; poultry; vétérinaire; bétail; 兽医; "
    "牲畜; 獣医; 家畜; สัตวแพทย์; ปศุสัตว์",
    "gardening": "cây trồng; làm vườn; khu vườn; phân bón; bón phân; hạt giống; tưới nước; rễ; cành; vườn; chậu; garden; plants; fertili; seedling; pruning; jardin; engrais; 园艺; "
    "肥料; 園芸; 植物; ปุ๋ย; ต้นไม้",
    "beauty_lifestyle": "làm đẹp; thời trang; mỹ phẩm; trang điểm; người mẫu; beauty; fashion; cosmetic; makeup; hairstyle; maquillage; "
    "coiffure; 美容; 时尚; 美容; 化粧; เครื่องสำอาง; แฟชั่น",
    "sport": "thể thao; trận đấu; vận động viên; huấn luyện viên; huy chương; match; athlete; tournament; coach; referee; tournoi; "
    "entraîneur; 比赛; 运动员; 試合; 選手; กีฬา; แข่งขัน",
    "software_technology": "phần mềm; công nghệ; máy chủ; lập trình; ứng dụng; software; server; developer; programm; computer; logiciel; "
    "serveur; 软件; 服务器; ソフト; サーバー; ซอฟต์แวร์; เซิร์ฟเวอร์",
    "community_charity": "thiện nguyện; từ thiện; mồ côi; người nghèo; gây quỹ; ủng hộ; quyên góp; học bổng; charity; donat; fundrais; gifts; bénévole; "
    "dons; 慈善; 志愿者; 寄付; ボランティア; บริจาค; อาสาสมัคร",
}
